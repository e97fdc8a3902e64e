"""Risk bands, labels, hours bands and advice. All work on the unrounded score."""

from pyspark.sql import Column, functions as F

from ..schema import ADVICE, DEFAULT_THRESHOLD, FIVE_BANDS, HOURS_BANDS, MODERATE_FROM
from .text import col


def risk_band(score, threshold: float = DEFAULT_THRESHOLD) -> Column:
    s = col(score)
    return F.when(s >= threshold, "Elevated").when(s >= MODERATE_FROM, "Moderate").when(s.isNotNull(), "Low")


def risk_band5(score) -> Column:
    s = col(score)
    out = F.when(s.isNull(), None)
    for floor, name in FIVE_BANDS:
        out = out.when(s >= floor, name)
    return out.otherwise("LOW")


def elevated(score, threshold: float = DEFAULT_THRESHOLD) -> Column:
    """0/1 label, NULL for a NULL score."""
    return (col(score) >= threshold).cast("int")


def predicted_class(probability, cut: float = 0.5) -> Column:
    return (col(probability) >= cut).cast("int")


def hours_band(hours, missing: float = 40.0) -> Column:
    """Right-closed bands; NULL hours count as ``missing``; values in no band give NULL."""
    h = F.coalesce(col(hours), F.lit(missing))
    out = None
    for low, high, label in HOURS_BANDS:
        inside = (h > low) & (h <= high)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def advice(score) -> Column:
    """Array of recommendation texts for the score's tier."""
    s = col(score)
    out = F.when(s.isNull(), None)
    for floor, texts in ADVICE:
        lines = F.array(*[F.lit(t) for t in texts])
        out = out.otherwise(lines) if floor is None else out.when(s >= floor, lines)
    return out
