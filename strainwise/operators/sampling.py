"""Repeatable splits, folds and samples keyed on a hash of the row id."""

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.bounds import materialize, small_side
from ..plans.quantiles import exact_quantiles
from ..schema import SEED

# 13 hexadecimal digits: an integer that a double holds exactly
DIGITS = 13
SPAN = float(16 ** DIGITS)


def hash_key(id_col: str, seed: int = SEED) -> Column:
    """Even spread of ids over 0 .. 16^13, the same on every engine and partitioning."""
    text = F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("bigint")


def with_split(df: DataFrame, id_col: str = "employee_id", test: float = 0.20, seed: int = SEED,
               stratify: str | None = None) -> DataFrame:
    """Append ``split`` ('train'/'test').

    Plain: each id falls into test with chance ``test``, decided from the id alone,
    no shuffle. Stratified: the ids with the lowest hashes of each stratum, exactly
    ``ceil(test * n)`` of them; only the cut-off hash per stratum is computed.
    """
    key = hash_key(id_col, seed)
    if stratify is None:
        return df.withColumn("split", F.when(key < F.lit(int(test * SPAN)), "test").otherwise("train"))
    keyed = df.withColumn("_h", key.cast("double"))
    cuts = materialize(exact_quantiles(keyed, ["_h"], [test], by=stratify).select(
        F.col(stratify).alias("_s"), F.element_at("_h", 1).alias("_cut")))
    joined = keyed.join(small_side(cuts, cuts.count()), F.col(stratify).eqNullSafe(F.col("_s")), "left")
    return joined.withColumn("split", F.when(F.col("_h") <= F.col("_cut"), "test").otherwise("train")).drop("_h", "_s", "_cut")


def with_fold(df: DataFrame, id_col: str = "employee_id", folds: int = 3, seed: int = SEED,
              stratify: str | None = None) -> DataFrame:
    """Append ``fold`` (0 to ``folds - 1``): by hash of the id, or equal shares of every stratum."""
    if stratify is None:
        return df.withColumn("fold", F.pmod(hash_key(id_col, seed), F.lit(folds)).cast("int"))
    keyed = df.withColumn("_h", hash_key(id_col, seed).cast("double"))
    cuts = materialize(exact_quantiles(keyed, ["_h"], [i / folds for i in range(1, folds)], by=stratify).select(
        F.col(stratify).alias("_s"), F.col("_h").alias("_cuts")))
    joined = keyed.join(small_side(cuts, cuts.count()), F.col(stratify).eqNullSafe(F.col("_s")), "left")
    above = F.size(F.filter("_cuts", lambda cut: F.col("_h") > cut))
    return joined.withColumn("fold", above.cast("int")).drop("_h", "_s", "_cuts")


def hash_sample(df: DataFrame, n: int, id_col: str = "employee_id", seed: int = SEED) -> DataFrame:
    """``n`` rows, the same ones on every run."""
    return df.withColumn("_h", hash_key(id_col, seed)).orderBy("_h", id_col).limit(n).drop("_h")
