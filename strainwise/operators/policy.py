"""Policy what-if and per-role drivers."""

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numbers import cap
from ..plans.bounds import materialize, one_row
from ..schema import DEFAULT_THRESHOLD, DRIVERS, MODERATE_FROM, NO_DRIVER, POLICIES
from .scoring import Scorer

BASELINE = "baseline"


def policy_whatif(filled: DataFrame, scorer: Scorer, policies=POLICIES, threshold: float = DEFAULT_THRESHOLD,
                  total_rows: int | None = None) -> DataFrame:
    """Effect of every policy on the whole roster, one row per policy.

    Each row is scored once as it is and once per policy, in one pass; only sums
    are shuffled. ``score_drop``, ``rate_drop`` and ``protected_employees`` never go
    below 0.01, 0.1 and 1; the ``raw_*`` columns are the plain differences.
    """
    capped = sorted({c for p in policies for c in p["caps"]})
    unlimited = F.lit(float("inf"))

    def variant(name, caps):
        return F.struct(F.lit(name).alias("id"),
                        *[(F.lit(float(caps[c])) if c in caps else unlimited).alias(c) for c in capped])

    variants = F.array(variant(BASELINE, {}), *[variant(p["id"], p["caps"]) for p in policies])
    rows = filled.withColumn("_v", F.explode(variants))
    rows = rows.withColumns({c: cap(c, F.col(f"_v.{c}")) for c in capped})
    sums = scorer(rows).groupBy(F.col("_v.id").alias("id")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("score").alias("mean"),
        (F.avg(F.when(F.col("score") >= threshold, 1.0).otherwise(0.0)) * 100.0).alias("rate"),
    )
    # one row per policy and the baseline: a window over a handful of rows
    line = Window.partitionBy()
    base = {c: F.max(F.when(F.col("id") == BASELINE, F.col(c))).over(line) for c in ("mean", "rate")}
    told = sums.withColumns({"mean_0": base["mean"], "rate_0": base["rate"]}).where(F.col("id") != BASELINE)
    n = F.col("n") if total_rows is None else F.lit(total_rows)
    told = told.withColumns({
        "score_drop": F.round(F.greatest(F.lit(0.01), F.col("mean_0") - F.col("mean")), 2),
        "rate_drop": F.round(F.greatest(F.lit(0.1), F.col("rate_0") - F.col("rate")), 1),
    })
    return told.select(
        "id", *_texts(policies), "score_drop",
        F.round("mean", 2).alias("sim_score"),
        "rate_drop",
        F.round("rate", 1).alias("sim_elev_rate"),
        F.greatest(F.lit(1).cast("bigint"), F.rint(n * F.col("rate_drop") / 100.0).cast("bigint")).alias("protected_employees"),
        F.round(F.col("mean_0") - F.col("mean"), 4).alias("raw_score_drop"),
        F.round(F.col("rate_0") - F.col("rate"), 4).alias("raw_rate_drop"),
    )


def _texts(policies) -> list:
    out = []
    for c in ("title", "badge", "description", "action", "effort"):
        by_id = F.create_map(*[F.lit(x) for p in policies for x in (p["id"], p[c])])
        out.append(by_id[F.col("id")].alias(c))
    preset = F.create_map(*[x for p in policies for x in (
        F.lit(p["id"]), F.create_map(*[F.lit(y) for kv in p["preset"].items() for y in kv]))])
    return [*out, preset[F.col("id")].alias("preset")]


def role_drivers(scored: DataFrame, by: str = "job_role", drivers=DRIVERS, top: int = 2) -> DataFrame:
    """Per role the ``top`` metrics furthest above the low-strain cohort.

    The cohort is the rows scoring below the moderate band, or all rows when there
    is none. Output: ``name, drivers`` (array of ``name, delta``).

    The scored rows are read once: sums per role, written out, give both the role
    means and the cohort means.
    """
    metrics = [d for d in drivers if d[0] in scored.columns]
    low = F.col("score") < MODERATE_FROM
    sums = [F.count(F.when(low, 1)).alias("low_rows")]
    for m, *_ in metrics:
        of_low = F.when(low, F.col(m))
        sums += [F.sum(m).alias(f"s_{m}"), F.count(m).alias(f"n_{m}"),
                 F.sum(of_low).alias(f"ls_{m}"), F.count(of_low).alias(f"ln_{m}")]
    per_role = materialize(scored.groupBy(F.col(by).cast("string").alias("name")).agg(*sums))
    in_low = F.sum("low_rows") > 0
    cohort = one_row(per_role.agg(*[
        F.when(in_low, F.try_divide(F.sum(f"ls_{m}"), F.sum(f"ln_{m}")))
        .otherwise(F.try_divide(F.sum(f"s_{m}"), F.sum(f"n_{m}"))).alias(m) for m, *_ in metrics]))

    def gap(m):
        return F.try_divide(F.col(f"s_{m}"), F.col(f"n_{m}")) - F.lit(cohort[m]).cast("double")

    found = F.array(*[
        F.struct((-gap(m) / full).alias("weak"), F.lit(i).alias("place"), F.lit(label).alias("name"),
                 F.concat(F.lit("+"), F.format_string("%.1f", F.round(gap(m), 1)), F.lit(unit)).alias("delta"),
                 (gap(m) > least).alias("counts"))
        for i, (m, label, least, full, unit) in enumerate(metrics)])
    roles = per_role.where(F.col("name").isNotNull())
    best = F.slice(F.array_sort(F.filter(found, lambda d: d["counts"])), 1, top)
    told = F.transform(best, lambda d: F.struct(d["name"].alias("name"), d["delta"].alias("delta")))
    none = F.array(F.struct(F.lit(NO_DRIVER[0]).alias("name"), F.lit(NO_DRIVER[1]).alias("delta")))
    return roles.select("name", F.when(F.size(told) > 0, told).otherwise(none).alias("drivers"))


def role_report(role_groups: DataFrame, drivers: DataFrame) -> DataFrame:
    """Role breakdown with its drivers; a role without drivers gets an empty list."""
    empty = F.expr("cast(array() as array<struct<name:string,delta:string>>)")
    return role_groups.join(drivers, "name", "left").withColumn("drivers", F.coalesce("drivers", empty))
