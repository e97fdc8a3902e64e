"""Exact, interpolated quantiles of many columns, per group and overall.

Rows are first counted per group, column and value, so that a value held by a third of
all rows is one row per task. The counts are dealt to range partitions, as many as
there are counts, and ranks are located by the totals of the partitions. Only partitions
that hold a wanted rank are accumulated; no task ever holds a whole group.
"""

from pyspark.sql import DataFrame, Window, functions as F

from .bounds import materialize

# Distinct values that one task accumulates.
PART_ROWS = 500_000
# Marks the all-rows line of a grouped result.
TOTAL = "is_total"
PART = "_part"


def ranged(df: DataFrame, order, part_rows: int = PART_ROWS) -> DataFrame:
    """Stored rows in range partitions by the columns ``order``, numbered in ``_part``.

    The number of partitions follows the number of rows; rows must be distinct in
    ``order``, so that no value lies in two partitions.
    """
    kept = materialize(df)
    parts = kept.count() // part_rows + 1
    return materialize(kept.repartitionByRange(int(parts), *order).withColumn(PART, F.spark_partition_id()))


def value_counts(df: DataFrame, columns, by=None, with_total: bool = False) -> DataFrame:
    """``is_total, _g, metric, value, n``: rows per group, column and value, NULL values left out."""
    group = F.col(by) if by else F.lit(None).cast("string")
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                                  for c in columns]))
    long = df.select(group.alias("_g"), entries.alias("e")).select("_g", "e.*").where("value is not null")
    counts = long.groupBy("_g", "metric", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(F.lit(by is None).alias(TOTAL), "_g", "metric", "value", "n")
    if by and with_total:
        counts = materialize(counts)
        overall = counts.groupBy("metric", "value").agg(F.sum("n").alias("n"))
        counts = counts.unionByName(overall.select(
            F.lit(True).alias(TOTAL), F.lit(None).cast(df.schema[by].dataType).alias("_g"), "metric", "value", "n"))
    return counts


def exact_quantiles(df: DataFrame, columns, probs, by=None, with_total=False, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per group; each column holds the array of its quantiles (NULL if no value).

    ``by`` is one grouping column. ``with_total`` adds a row over all rows, marked in
    ``is_total``. A group all of whose values are NULL has no row.
    """
    columns, probs = list(columns), [float(p) for p in probs]
    key = [TOTAL, "_g", "metric"]
    counts = ranged(value_counts(df, columns, by, with_total), [*key, "value"], part_rows)

    # Rank range of every partition: one row per group, column and partition it reaches into.
    line = Window.partitionBy(*key)
    upto = line.orderBy(PART).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slots = (counts.groupBy(*key, PART).agg(F.sum("n").alias("rows"))
             .withColumn("before", F.sum("rows").over(upto) - F.col("rows"))
             .withColumn("all_rows", F.sum("rows").over(line)))
    place = [F.lit(p) * (F.col("all_rows") - 1) for p in probs]
    ranks = F.array(*[F.struct(F.lit(i).alias("slot"), F.floor(pos).alias("low"), F.ceil(pos).alias("high"),
                               (pos - F.floor(pos)).alias("share")) for i, pos in enumerate(place)])
    slots = slots.withColumn(
        "ranks", F.filter(ranks, lambda r: (r["high"] >= F.col("before"))
                          & (r["low"] < F.col("before") + F.col("rows")))
    ).where(F.size("ranks") > 0).drop("rows", "all_rows")

    # Only the hit partitions are accumulated, each on its own.
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*key, PART]]
    hit = counts.alias("c").join(slots.alias("s"), same).select("c.*", "s.before", "s.ranks")
    inside = (Window.partitionBy(*key, PART).orderBy("value")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hit = hit.withColumn("last", F.col("before") + F.sum("n").over(inside))
    hit = hit.withColumn("first", F.col("last") - F.col("n")).select(
        *key, "value", "first", "last", F.explode("ranks").alias("r"))

    def holds(rank):
        return F.when((rank >= F.col("first")) & (rank < F.col("last")), F.col("value"))

    found = hit.groupBy(*key, "r.slot").agg(
        F.max(holds(F.col("r.low"))).alias("low"), F.max(holds(F.col("r.high"))).alias("high"),
        F.max("r.share").alias("share"))
    found = found.withColumn("q", F.col("low") + (F.col("high") - F.col("low")) * F.col("share"))
    arrays = found.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "q"))), lambda x: x["q"]).alias("qs"))
    wide = arrays.groupBy(TOTAL, "_g").pivot("metric", columns).agg(F.first("qs"))
    if not by:
        # an ungrouped aggregate always has one row
        return wide.agg(*[F.first(c, True).alias(c) for c in columns])
    wide = wide.withColumnRenamed("_g", by)
    return wide.select(by, TOTAL, *columns) if with_total else wide.select(by, *columns)


def exact_medians(df: DataFrame, columns, by=None, **options) -> DataFrame:
    out = exact_quantiles(df, columns, [0.5], by=by, **options)
    return out.withColumns({c: F.element_at(c, 1) for c in columns})
