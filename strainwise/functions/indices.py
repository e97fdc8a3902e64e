"""Composite indices and the linear strain index."""

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import STRAIN_WEIGHTS
from .numbers import clip, total

# Columns reported on a 0-10 or a 0-100 scale, whichever the caller states.
SCALED = ("job_satisfaction", "manager_support", "work_life_balance")


def workload_index() -> Column:
    return 100.0 * (
        0.4 * (F.col("work_hours_per_week") / 40.0)
        + 0.3 * (F.col("overtime_hours") / 10.0)
        + 0.2 * (F.col("meetings_per_day") / 5.0)
        + 0.1 * (F.col("deadlines_missed") / 3.0)
    )


def wellness_score(scale: float = 100.0) -> Column:
    return 100.0 * (
        0.3 * clip(F.col("sleep_hours") / 8.0, 0.0, 1.2)
        + 0.2 * (F.col("physical_activity_days") / 7.0)
        + 0.3 * (F.col("work_life_balance") / scale)
        + 0.2 * (F.col("job_satisfaction") / scale)
    )


def support_index(scale: float = 100.0) -> Column:
    """Manager support brought to 0-100."""
    return F.col("manager_support") * (100.0 / scale)


def meeting_load() -> Column:
    return F.col("meetings_per_day") / 3.0


def with_indices(df: DataFrame, scale: float = 100.0) -> DataFrame:
    """Append the four indices; NULL in, NULL out. ``scale`` is 100 or 10."""
    return df.withColumns(
        {
            "workload_index": workload_index(),
            "wellness_score": wellness_score(scale),
            "support_index": support_index(scale),
            "meeting_load": meeting_load(),
        }
    )


def raw_strain(scale: float = 100.0, value=F.col) -> Column:
    """Weighted sum behind the strain index; ``value`` maps a metric name to its column."""

    def term(metric, weight, divisor):
        unit = scale / 10.0 if metric in SCALED else 1.0
        return F.lit(weight) * (value(metric) / (divisor * unit))

    return total([term(*w) for w in STRAIN_WEIGHTS])
