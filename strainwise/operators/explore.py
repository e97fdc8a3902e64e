"""Descriptive statistics of the master table."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..plans.bounds import materialize, one_row, small_side
from ..plans.quantiles import exact_quantiles
from ..plans.sketch import SIZE, quantile_sketches, sketch_quantiles
from ..schema import CORRELATED, DEFAULT_THRESHOLD, TARGET

# Pairs that one aggregate correlates.
PAIRS = 15


def describe(df: DataFrame, columns, digits: int = 4, **options) -> DataFrame:
    """Count, mean, std, min, quartiles and max per column, one row each."""
    q = one_row(exact_quantiles(df, columns, [0.25, 0.5, 0.75], **options))
    stats = df.agg(*[F.struct(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                              F.min(c).alias("min"), F.max(c).alias("max")).alias(c) for c in columns])

    def r(x):
        return F.round(x.cast("double"), digits)

    def quartile(c, i):
        return r(F.lit(q[c][i] if q[c] else None))

    lines = F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c)["count"].alias("count"), r(F.col(c)["mean"]).alias("mean"),
                 r(F.col(c)["std"]).alias("std"), r(F.col(c)["min"]).alias("min"),
                 quartile(c, 0).alias("q25"), quartile(c, 1).alias("median"), quartile(c, 2).alias("q75"),
                 r(F.col(c)["max"]).alias("max"))
        for c in columns])
    return stats.select(F.inline(lines))


def column_profile(df: DataFrame) -> DataFrame:
    """Type, non-NULL count and row count per column."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(f"`{c}`").alias(c) for c in df.columns])
    lines = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.lit(t).alias("type"),
                 F.col(f"`{c}`").alias("filled"), F.col("_rows").alias("rows"))
        for i, (c, t) in enumerate(df.dtypes)])
    return counts.select(F.inline(lines))


def histogram(df: DataFrame, c: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows per equal-width bin; bins are closed on the left, the last one on both sides.

    Bin -1 counts values below ``low``, bin ``bins`` those above ``high``.
    """
    width = (high - low) / bins
    x = F.col(c)
    place = F.when(x < low, -1).when(x > high, bins).otherwise(
        F.least(F.lit(bins - 1), F.floor((x - low) / width)).cast("int"))
    counts = df.where(x.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    empty = df.sparkSession.range(-1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    # both sides hold a row per bin
    return empty.join(F.broadcast(counts), "bin", "left").select(
        "bin", F.when(F.col("bin") >= 0, F.round(low + F.col("bin") * width, 6)).alias("low"),
        F.when(F.col("bin") < bins, F.round(low + (F.col("bin") + 1) * width, 6)).alias("high"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("rows"))


def boxplot(df: DataFrame, by: str, c: str = TARGET, digits: int = 4, **options) -> DataFrame:
    """Quartiles, whiskers (1.5 IQR) and outlier count per group."""
    rows = df.where(F.col(c).isNotNull() & F.col(by).isNotNull()).select(by, F.col(c).alias("_v"))
    q = materialize(exact_quantiles(rows, ["_v"], [0.25, 0.5, 0.75], by=by, **options)).select(
        by, F.element_at("_v", 1).alias("q1"), F.element_at("_v", 2).alias("med"), F.element_at("_v", 3).alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    low, high = F.col("q1") - reach, F.col("q3") + reach
    v = F.col("_v")
    return (rows.join(small_side(q, q.count()), by)
            .groupBy(by)
            .agg(F.count(F.lit(1)).alias("rows"),
                 F.round(F.max("q1"), digits).alias("q1"), F.round(F.max("med"), digits).alias("median"),
                 F.round(F.max("q3"), digits).alias("q3"),
                 F.round(F.min(F.when(v >= low, v)), digits).alias("whisker_low"),
                 F.round(F.max(F.when(v <= high, v)), digits).alias("whisker_high"),
                 F.count(F.when((v < low) | (v > high), 1)).alias("outliers")))


def correlation(df: DataFrame, columns=CORRELATED, digits: int = 4) -> DataFrame:
    """Pearson correlation of every pair (lower triangle), pairwise complete rows.

    Aggregates of at most 15 pairs, so that each stays within generated code; a row is
    read once per block of pairs, not once per metric.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    blocks = []
    for i in range(0, len(pairs), PAIRS):
        own = pairs[i:i + PAIRS]
        found = df.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(own)])
        blocks.append(found.select(F.inline(F.array(*[
            F.struct(F.lit(a).alias("left_metric"), F.lit(b).alias("right_metric"), F.round(f"c{k}", digits).alias("corr"))
            for k, (a, b) in enumerate(own)]))))
    return reduce(DataFrame.unionByName, blocks)


def label_counts(df: DataFrame, source: str = "source_dataset", target: str = TARGET) -> DataFrame:
    """Rows and labelled rows per source."""
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("total_rows"), F.count(target).alias("labeled_rows"))


def class_balance(df: DataFrame, threshold: float = DEFAULT_THRESHOLD, target: str = TARGET) -> DataFrame:
    """Positives, negatives, positive rate and negative/positive ratio of labelled rows."""
    y = F.col(target)
    counts = df.where(y.isNotNull()).agg(F.count(F.when(y >= threshold, 1)).alias("positives"),
                                         F.count(F.when(y < threshold, 1)).alias("negatives"))
    p, n = F.col("positives"), F.col("negatives")
    return counts.select("positives", "negatives", F.round(F.try_divide(p, p + n), 4).alias("positive_rate"),
                         F.round(n / F.greatest(p, F.lit(1)), 4).alias("pos_weight"))


def approximate_quantiles(df: DataFrame, columns, probs, size: int = SIZE) -> DataFrame:
    """``metric, prob, value`` from one scan and sketches of at most ``size`` entries per task and column.

    The rank of a value is off by a few times ``1 / size`` of the rows at most; columns with
    no more than ``size`` distinct values are exact (the value at the rank, not interpolated).
    For tables that grow, keep :func:`quantile_sketches` of each batch and merge them.
    """
    return sketch_quantiles(quantile_sketches(df, columns, size=size), probs)


def rank_errors(df: DataFrame, found: DataFrame, columns) -> DataFrame:
    """``metric, prob, value, error``: how far the ranks of found quantiles are off, as a share of the rows.

    ``found`` has a few rows per column; one aggregate counts the rows below and up to each.
    """
    rows = found.collect()
    counts = df.agg(*[F.struct(F.count(r["metric"]).alias("n"), F.count(F.when(F.col(r["metric"]) < r["value"], 1)).alias("low"),
                               F.count(F.when(F.col(r["metric"]) <= r["value"], 1)).alias("high")).alias(f"q{i}") for i, r in enumerate(rows)])
    lines = []
    for i, r in enumerate(rows):
        q, wanted = F.col(f"q{i}"), F.lit(r["prob"]) * F.col(f"q{i}")["n"]
        off = F.greatest(F.lit(0.0), q["low"] - wanted, wanted - q["high"]) / q["n"]
        lines.append(F.struct(F.lit(r["metric"]).alias("metric"), F.lit(r["prob"]).alias("prob"), F.lit(r["value"]).alias("value"), off.alias("error")))
    return counts.select(F.inline(F.array(*lines)))


def quantile_threshold(df: DataFrame, target: str = TARGET, quantile: float = 0.90, **options) -> DataFrame:
    """One row: the interpolated quantile of the target."""
    return exact_quantiles(df, [target], [quantile], **options).select(
        F.element_at(target, 1).alias("threshold"))
