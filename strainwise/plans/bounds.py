"""Size checks behind every broadcast, and the shared scratch folder."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

# At most this many narrow rows are sent to every executor.
MAX_BROADCAST_ROWS = 200_000


def distinct_counts(df: DataFrame, columns) -> dict:
    """Upper estimates of the distinct values per column, in one small aggregate.

    One binary sketch per column (1.6 % standard error); 10 % is added.
    """
    row = df.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(c))).alias(c) for c in columns]).first()
    return {c: int(row[c] * 1.1) + 1 for c in columns}


def small_side(df: DataFrame, rows: int, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only if its known row bound allows; else leave the join to AQE."""
    return F.broadcast(df) if rows <= max_rows else df


def one_row(df: DataFrame) -> dict:
    """The single row of an ungrouped aggregate, fetched once as a plain dict.

    Statistics fitted this way enter later plans as literals: no join, no repeated
    scan of the reference table.
    """
    return df.first().asDict()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="strainwise-")
    path = f"{root.rstrip('/')}/strainwise-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


_SCOPES: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession):
    """Scratch folders made inside are deleted at the end; :func:`outlive` stores what is to stay."""
    own: list[str] = []
    _SCOPES.append(own)
    try:
        yield
    finally:
        _SCOPES.remove(own)
        for path in own:
            drop_scratch(spark, path)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that no later step reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def outlive(df: DataFrame) -> DataFrame:
    """Store ``df`` so that it stays when the innermost scratch scope ends."""
    own = _SCOPES.pop()
    try:
        return materialize(df)
    finally:
        _SCOPES.append(own)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so later passes reuse the work.

    The files outlive lost executors; the folder is the cluster's to clean.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_scratch(df))


def write_scratch(df: DataFrame) -> str:
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return path
