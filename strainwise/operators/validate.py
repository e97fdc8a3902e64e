"""Training-data checks and feature selection."""

import math

from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.bounds import MAX_BROADCAST_ROWS, materialize, small_side
from ..schema import ENGINEERED, LEAKING, PIPELINE_EXCLUDED, REQUIRED_TRAINING, SENSITIVE, TARGET

# Rows that a task compares, and parts that copies of one row are first dealt to.
TASK_ROWS = 1_000_000
SALTS = 16


def count_duplicates(df: DataFrame) -> int:
    """Rows beyond the first of every set of exactly equal rows.

    Only row hashes are shuffled at first. Rows whose hash occurs twice are then
    compared in full; when there are few such hashes, only those rows move. Partitions
    grow in number with the rows, so a task holds no more of a larger table. Copies from
    different parts of the table meet in two steps: very many of one row never meet in one task.
    """
    parts = max(1, math.ceil(df.count() / TASK_ROWS))
    doubles = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    # adding zero makes -0.0 and 0.0 hash alike, as they compare
    values = [F.col(f"`{c}`") + F.lit(0.0) if c in doubles else F.col(f"`{c}`") for c in df.columns]
    hashed = df.withColumn("_row_hash", F.xxhash64(*values)).withColumn("_salt", F.spark_partition_id() % SALTS)

    def copies(rows, columns):
        near = rows.repartition(parts, "_row_hash", "_salt").groupBy("_row_hash", "_salt", *columns).agg(F.count(F.lit(1)).alias("_copies"))
        return near.repartition(parts, "_row_hash").groupBy("_row_hash", *columns).agg(F.sum("_copies").alias("_copies")).where("_copies > 1")

    repeated = materialize(copies(hashed.select("_row_hash", "_salt"), []).select("_row_hash"))
    found = repeated.count()
    if found == 0:
        return 0
    # a join with many hashes would move all rows, and sort them, before they move again
    suspects = hashed.join(small_side(repeated, found), "_row_hash", "left_semi") if found <= MAX_BROADCAST_ROWS else hashed
    return copies(suspects, [f"`{c}`" for c in df.columns]).agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("n")).first()["n"]


def violations(df: DataFrame, required=REQUIRED_TRAINING, target: str = TARGET) -> DataFrame:
    """One row per rule: ``check, violations``. Zero everywhere means fit for training."""
    absent = sorted(set(required) - set(df.columns))
    if target not in df.columns:
        return df.sparkSession.createDataFrame(
            [("required_columns", len(absent))], "check string, violations bigint")
    y = F.col(f"`{target}`")
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(y.isNull(), 1)).alias("missing_target"),
        F.count(F.when((y < 0) | (y > 10), 1)).alias("target_out_of_range"),
    )
    found = {
        "required_columns": F.lit(len(absent)).cast("bigint"),
        "empty": (F.col("rows") == 0).cast("bigint"),
        "missing_target": F.col("missing_target"),
        "target_out_of_range": F.col("target_out_of_range"),
        "duplicate_rows": F.lit(count_duplicates(df)).cast("bigint"),
    }
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("check"), v.alias("violations")) for name, v in found.items()])))


def require_valid(df: DataFrame, **options) -> DataFrame:
    """``df`` itself, or an error naming the broken rules (at most five rows are fetched)."""
    broken = [r["check"] for r in violations(df, **options).where("violations > 0").collect()]
    if broken:
        raise ValueError("training data rejected: " + ", ".join(sorted(broken)))
    return df


def drop_engineered(df: DataFrame) -> DataFrame:
    return df.drop(*ENGINEERED)


def model_columns(columns, pipeline: bool = False) -> list:
    """Sorted feature names without target, leaking, personal and health columns.

    The ``pipeline`` list also leaves out ids, segment, stress, fatigue, the
    engineered columns and the missing flags.
    """
    out = set(columns) - {TARGET} - set(LEAKING) - set(SENSITIVE)
    if pipeline:
        # the cluster is computed from the target, like the segment it names
        out -= set(PIPELINE_EXCLUDED) | set(ENGINEERED) | {"cluster_id"}
        out = {c for c in out if not c.endswith("_is_missing")}
    return sorted(out)


def select_features(df: DataFrame, pipeline: bool = False) -> DataFrame:
    return df.select(*model_columns(df.columns, pipeline))


def by_type(df: DataFrame, names) -> tuple[list, list]:
    """The numeric ones of the named columns, and all others."""
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    return [c for c in names if c in numeric], [c for c in names if c not in numeric]


def labeled(df: DataFrame, target: str = TARGET) -> DataFrame:
    return df.where(F.col(target).isNotNull())
