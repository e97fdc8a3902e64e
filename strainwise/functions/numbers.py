"""Null-safe numeric expressions."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .text import col


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column (Spark sorts NaN above all numbers)."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        [F.when(~F.isnan(c), F.col(c)).alias(c) if c in floating else F.col(c) for c in df.columns]
    )


def clip(c, low: float, high: float) -> Column:
    """Clip to [low, high]; NULL stays NULL (``least``/``greatest`` alone would skip it)."""
    x = col(c)
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def cap(c, high) -> Column:
    x = col(c)
    return F.when(x.isNotNull(), F.least(x, high))


def share(flag: Column, digits: int = 1) -> Column:
    """Percentage of all rows, NULL flags included in the denominator."""
    hits = F.sum(F.when(flag, 1).otherwise(0))
    return F.round(F.try_divide(hits * 100.0, F.count(F.lit(1))), digits)


def total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)
