"""Group breakdowns, organisation summaries and state resolution."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.bands import hours_band
from ..functions.numbers import share
from ..functions.text import as_number, strip
from ..schema import BANDS, CITY_STATES, DEFAULT_THRESHOLD, MODERATE_FROM

UNKNOWN = "Unknown"


def group_measures(score: str, threshold: float) -> list:
    return [
        F.round(F.avg(score), 2).alias("mean_score"),
        share(F.col(score) >= threshold).alias("elevated_rate"),
        F.count(F.lit(1)).alias("employees"),
    ]


def top_groups(groups: DataFrame, limit: int = 20) -> DataFrame:
    """Highest mean first, then most employees, then name."""
    return groups.orderBy(F.desc("mean_score"), F.desc("employees"), "name").limit(limit)


def breakdown(scored: DataFrame, key, limit: int | None = None, score: str = "score",
              threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """``name, mean_score, elevated_rate, employees`` per key, all of them unless ``limit`` is given.

    NULL counts as Unknown.
    """
    name = key if isinstance(key, Column) else F.col(key)
    groups = scored.groupBy(F.coalesce(name.cast("string"), F.lit(UNKNOWN)).alias("name")).agg(
        *group_measures(score, threshold))
    return groups if limit is None else top_groups(groups, limit)


def breakdown_hours(scored: DataFrame, hours: str = "work_hours_per_week", **options) -> DataFrame:
    """Per hours band; empty bands and values in no band are left out."""
    number = as_number(hours) if dict(scored.dtypes)[hours] == "string" else F.col(hours)
    banded = scored.withColumn("_hours_band", hours_band(number)).where("_hours_band is not null")
    return breakdown(banded, "_hours_band", **options)


def breakdown_all(scored: DataFrame, keys, limit: int | None = None, score: str = "score",
                  threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Several breakdowns from one scan: ``dimension, name, ..., place``; with ``limit`` the best ones of each."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(k).alias("dimension"), F.coalesce(F.col(k).cast("string"), F.lit(UNKNOWN)).alias("name"))
        for k in keys]))
    groups = (scored.select(score, pairs.alias("p")).groupBy("p.dimension", "p.name")
              .agg(*group_measures(score, threshold)))
    rank = Window.partitionBy("dimension").orderBy(F.desc("mean_score"), F.desc("employees"), "name")
    placed = groups.withColumn("place", F.row_number().over(rank))
    return placed if limit is None else placed.where(F.col("place") <= limit)


def city_states(spark) -> DataFrame:
    """The fixed city table (under a hundred rows)."""
    pairs = F.create_map(*[F.lit(x) for pair in CITY_STATES.items() for x in pair])
    return spark.range(1).select(F.explode(pairs).alias("city_key", "state_name"))


def with_city_state(df: DataFrame, city: str = "city", name: str = "state") -> DataFrame:
    """State by city dictionary; unknown cities give NULL."""
    states = city_states(df.sparkSession).withColumnRenamed("state_name", name)
    keyed = df.drop(name).withColumn("city_key", F.lower(strip(F.col(city).cast("string"))))
    return keyed.join(F.broadcast(states), "city_key", "left").drop("city_key")


def with_state(df: DataFrame, state: str | None = None, city: str | None = None, name: str = "state") -> DataFrame:
    """Own state column if there is one, else the city dictionary, else NULL."""
    if state:
        return df.withColumn(name, F.col(state).cast("string"))
    if city:
        return with_city_state(df, city, name)
    return df.withColumn(name, F.lit(None).cast("string"))


def known_state(df: DataFrame, state: str = "state") -> DataFrame:
    return df.where(F.col(state).isNotNull() & ~F.col(state).isin("None", "nan"))


def breakdown_state(scored: DataFrame, state: str = "state", **options) -> DataFrame:
    return breakdown(known_state(scored, state), state, **options)


def _band_counts(score: Column, threshold: float) -> list:
    flags = (score < MODERATE_FROM, (score >= MODERATE_FROM) & (score < threshold), score >= threshold)
    return [F.count(F.when(flag, 1)).alias(band.lower()) for band, flag in zip(BANDS, flags)]


def fleet_summary(scored: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """One row over a scored roster."""
    return scored.agg(*fleet_measures(threshold))


def fleet_measures(threshold: float = DEFAULT_THRESHOLD) -> list:
    s = F.col("score")
    return [
        F.count(F.lit(1)).alias("employees"),
        F.round(F.avg(s), 2).alias("mean_strain_score"),
        share(s >= threshold).alias("elevated_review_rate"),
        F.round(F.avg("probability") * 100.0, 1).alias("mean_elevated_probability"),
        *_band_counts(s, threshold),
    ]


def org_summary(master: DataFrame, threshold: float = DEFAULT_THRESHOLD, score: str = "strain_score") -> DataFrame:
    """One row over the master table; NULL scores are in no band but in the rate's denominator."""
    s = F.col(score)
    return master.agg(
        F.count(F.lit(1)).alias("employees"),
        F.round(F.avg(s), 2).alias("mean_strain"),
        share(s >= threshold).alias("elevated_rate"),
        F.round(F.avg("stress_level"), 2).alias("mean_stress"),
        F.lit(float(threshold)).alias("threshold"),
        *_band_counts(s, threshold),
    )


def mean_by(master: DataFrame, key: str, score: str = "strain_score") -> DataFrame:
    """Mean score per non-NULL key, highest first."""
    return (master.where(F.col(key).isNotNull()).groupBy(key)
            .agg(F.round(F.avg(score), 2).alias("mean_score")).orderBy(F.desc_nulls_last("mean_score"), key))


def elevated_by(df: DataFrame, key: str, threshold: float = DEFAULT_THRESHOLD, score: str = "strain_score") -> DataFrame:
    """Elevated percentage per non-NULL key, highest first."""
    return (df.where(F.col(key).isNotNull()).groupBy(key)
            .agg(share(F.col(score) >= threshold).alias("elevated_rate"))
            .orderBy(F.desc("elevated_rate"), key))


def band_distribution(scored: DataFrame, threshold: float = DEFAULT_THRESHOLD, score: str = "score") -> DataFrame:
    """Rows per band, empty bands included."""
    counts = scored.agg(*_band_counts(F.col(score), threshold))
    lines = F.array(*[F.struct(F.lit(b).alias("band"), F.col(b.lower()).alias("employees")) for b in BANDS])
    return counts.select(F.inline(lines))
