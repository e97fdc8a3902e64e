"""Small helpers of this subpackage: tables, stored results, bounded batches, connected components."""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.bounds import materialize, scratch_folder, write_scratch

# Texts are handed to Python in record batches of about this many bytes.
BATCH_BYTES = 8 << 20
# Vectorised code works on slices of at most about this many bytes of text.
SLICE_BYTES = 1 << 20

__all__ = ["BATCH_BYTES", "SLICE_BYTES", "arrow_limits", "table", "stored", "scratch_folder", "write_scratch",
           "slices", "records", "components", "only"]


def arrow_limits(spark: SparkSession) -> None:
    """Bound record batches by bytes, so that very long texts do not pile up in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    arrow_limits(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write to the cluster's shared folder and read back: lost executors cost only their own tasks."""
    return materialize(df)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named input columns under internal names; extra or clashing columns play no part."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Zero-copy parts of a batch holding at most ``limit`` bytes of ``column`` (one row may exceed it)."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def records(rows, schema: pa.Schema) -> pa.RecordBatch:
    """A record batch from row tuples."""
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _forest(batches):
    """Replace the edges of one partition by (node, smallest node it reaches here)."""
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    rows = [(x, r) for x in list(parent) if (r := find(x)) != x]
    for i in range(0, len(rows), 50_000):
        yield records(rows[i:i + 50_000], PAIR)


def components(edges: DataFrame, edges_per_task: int = 200_000) -> DataFrame:
    """``(id, component)`` for every node of the long pairs ``(a, b)``; component is the smallest node.

    Edges are first reduced to forests by tasks of about ``edges_per_task`` edges. Where
    forests of several tasks meet, alternating large and small stars link every node to
    its smallest neighbour until all hang on one. Each round is two joins on edges,
    written to the shared folder; only counts reach the driver. Nodes without a partner
    are absent. An empty input gives an empty result.
    """
    edges = stored(edges.select("a", "b").where("a <> b"))
    tasks = edges.count() // edges_per_task + 1
    now = stored(edges.coalesce(tasks).mapInArrow(_forest, "a long, b long"))
    while not _stars(now):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a keeps its smallest neighbour, its other smaller neighbours hang there too
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(moved.union(low.select("a", F.col("m").alias("b"))).distinct())
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def _stars(pairs: DataFrame) -> bool:
    """Whether every node has one link, to a node that has none itself."""
    return (pairs.join(pairs.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()
            and pairs.groupBy("a").count().where("count > 1").isEmpty())
