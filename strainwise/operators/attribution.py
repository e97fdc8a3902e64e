"""Which features move the score: exact linear shares and permutation importance."""

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.bounds import one_row
from ..plans.quantiles import PART, PART_ROWS, ranged
from ..schema import SEED
from .sampling import hash_key
from .scoring import Scorer


def linear_attribution(df: DataFrame, weights: dict) -> DataFrame:
    """Per row and feature ``weight * (x - mean x)``, added as ``attr_<feature>`` columns."""
    mean = one_row(df.agg(*[F.avg(c).alias(c) for c in weights]))
    return df.withColumns({f"attr_{c}": F.lit(float(w)) * (F.col(c) - F.lit(mean[c])) for c, w in weights.items()})


def mean_attribution(df: DataFrame, weights: dict, digits: int = 4) -> DataFrame:
    """Mean absolute attribution per feature, largest first."""
    each = linear_attribution(df, weights).agg(*[F.avg(F.abs(f"attr_{c}")).alias(c) for c in weights])
    return each.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.round(c, digits).alias("mean_abs")) for c in weights]))
    ).orderBy(F.desc("mean_abs"), "feature")


def shuffled_features(df: DataFrame, features, id_col: str = "employee_id", seed: int = SEED,
                      part_rows: int = PART_ROWS) -> DataFrame:
    """Append ``other_<feature>``: the values of the next row in the order of the ids' hashes.

    The last row takes those of the first. The order is one over all rows, whatever
    their number: rows lie in range partitions, and the last row of a partition takes
    the first one of the next partition that has any. Ids must be unique.
    """
    keyed = ranged(df.withColumn("_h", hash_key(id_col, seed)), ["_h", id_col], part_rows)
    row = F.struct(*features)
    heads = keyed.groupBy(PART).agg(F.min_by(row, F.struct("_h", id_col)).alias("_head"))
    line = Window.orderBy(PART)  # one row per partition
    after = heads.select(PART, F.coalesce(F.lead("_head").over(line), F.first("_head").over(line)).alias("_after"))
    order = Window.partitionBy(PART).orderBy("_h", id_col)
    moved = keyed.join(F.broadcast(after), PART).withColumn("_next", F.coalesce(F.lead(row).over(order), F.col("_after")))
    return moved.withColumns({f"other_{c}": F.col(f"_next.{c}") for c in features}).drop("_h", PART, "_after", "_next")


def permutation_importance(df: DataFrame, scorer: Scorer, features, target: str, id_col: str = "employee_id",
                           digits: int = 4, **options) -> DataFrame:
    """Rise of the RMSE when one feature is taken from another row, largest first.

    One shuffle draws the replacements; every row is then scored once untouched and
    once per feature in the same pass.
    """
    features = list(features)
    drawn = shuffled_features(df, features, id_col, **options)
    rows = drawn.withColumn("_f", F.explode(F.array(*[F.lit(c) for c in ["", *features]])))
    swapped = rows.withColumns({
        c: F.when(F.col("_f") == c, F.col(f"other_{c}")).otherwise(F.col(c)) for c in features})
    e = F.col(target) - F.col("score")
    rmse = scorer(swapped.drop(*[f"other_{c}" for c in features])).groupBy(F.col("_f").alias("feature")).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"))
    # one row per feature
    base = F.max(F.when(F.col("feature") == "", F.col("rmse"))).over(Window.partitionBy())
    return (rmse.withColumn("base", base).where("feature <> ''")
            .select("feature", F.round(F.col("rmse") - F.col("base"), digits).alias("rmse_rise"))
            .orderBy(F.desc("rmse_rise"), "feature"))
