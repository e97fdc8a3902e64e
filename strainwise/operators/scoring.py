"""Scorers and the one scoring path used by rosters, lookups, scenarios and what-ifs.

A scorer is a function ``DataFrame -> DataFrame`` that reads filled model features
and appends ``score`` (0-10) and ``probability`` (0-1).
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions.bands import risk_band
from ..functions.indices import raw_strain
from ..functions.numbers import clip
from ..plans.bounds import one_row
from ..schema import DEFAULT_THRESHOLD
from .align import align

Scorer = Callable[[DataFrame], DataFrame]


def strain_bounds(reference: DataFrame, scale: float = 100.0) -> tuple:
    """Lowest and highest raw strain of a table."""
    ends = one_row(reference.select(raw_strain(scale).alias("s")).agg(F.min("s").alias("low"), F.max("s").alias("high")))
    return ends["low"], ends["high"]


def linear_strain(df: DataFrame, scale: float = 100.0, bounds: tuple | None = None) -> DataFrame:
    """Append the linear strain index: fixed weights, then min-max to 0-10.

    The bounds are those of ``df`` unless given.
    """
    low, high = (F.lit(x).cast("double") for x in bounds or strain_bounds(df, scale))
    return df.withColumn("strain_index", F.try_divide(raw_strain(scale) - low, high - low) * 10.0)


def linear_scorer(reference: DataFrame, scale: float = 100.0) -> Scorer:
    """Deterministic scorer: the strain index on the bounds of ``reference``, clipped.

    Bounds stay those of the reference table, also when a what-if caps columns.
    The index carries no probability of its own; score / 10 stands in.
    """

    bounds = strain_bounds(reference, scale)

    def score(df: DataFrame) -> DataFrame:
        out = linear_strain(df, scale, bounds).withColumn("score", clip("strain_index", 0.0, 10.0))
        return out.withColumn("probability", F.col("score") / 10.0).drop("strain_index")

    return score


def score_features(filled: DataFrame, scorer: Scorer, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Score, probability and band for already filled rows."""
    return scorer(filled).withColumn("band", risk_band("score", threshold))


def score_roster(roster: DataFrame, defaults: dict, scorer: Scorer,
                 threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """The roster's own columns as given, plus score, probability and band.

    Gaps are filled only for scoring.
    """
    boxed = roster.withColumn("given", F.struct(*[F.col(f"`{c}`") for c in roster.columns]))
    scored = score_features(align(boxed, defaults, keep=["given"]), scorer, threshold)
    return scored.select("given.*", "score", "probability", "band")


def score_scenarios(filled: DataFrame, scorer: Scorer, threshold: float = DEFAULT_THRESHOLD, keep=()) -> DataFrame:
    """Answer table for scenario profiles."""
    return score_features(filled, scorer, threshold).select(
        *keep,
        F.round("score", 2).alias("strain_score"),
        F.round(F.col("probability") * 100.0, 1).alias("elevated_risk_probability"),
        F.col("band").alias("risk_band"),
        F.lit(float(threshold)).alias("threshold"),
    )
