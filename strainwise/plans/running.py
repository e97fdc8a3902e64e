"""Running totals over an ordered column without a single-task window."""

from pyspark.sql import DataFrame, Window, functions as F

from .quantiles import PART, PART_ROWS, ranged


def running_totals(df: DataFrame, order: str, sums, part_rows: int = PART_ROWS) -> DataFrame:
    """For each distinct ``order`` value, descending: its sums, the sums up to and
    including it (``cum_*``), the grand totals (``all_*``) and the next value's
    sums (``next_*``, NULL at the end).

    Rows are first aggregated per value, so the input is read once and one very common
    value costs one row. Values then lie in range partitions, as many as the values need;
    partition totals (one row each) give the offsets, and each partition is accumulated
    on its own.
    """
    per_value = df.where(F.col(order).isNotNull()).groupBy(order).agg(*[F.sum(s).alias(s) for s in sums])
    cut = ranged(per_value, [order], part_rows)
    top = F.max_by(F.struct(*sums), F.col(order))
    line = Window.orderBy(F.desc(PART))  # one row per partition
    sofar = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slots = cut.groupBy(PART).agg(top.alias("_top"), *[F.sum(s).alias(f"_t_{s}") for s in sums])
    slots = slots.select(
        PART, F.lead("_top").over(line).alias("_after"),
        *[(F.sum(f"_t_{s}").over(sofar) - F.col(f"_t_{s}")).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(Window.partitionBy()).alias(f"all_{s}") for s in sums],
    )
    rows = cut.join(F.broadcast(slots), PART)
    local = Window.partitionBy(PART).orderBy(F.desc(order))
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(
        order, *sums,
        *[(F.col(f"_o_{s}") + F.sum(s).over(upto)).alias(f"cum_{s}") for s in sums],
        *[f"all_{s}" for s in sums],
        *[F.coalesce(F.lead(s).over(local), F.col(f"_after.{s}")).alias(f"next_{s}") for s in sums],
    )
