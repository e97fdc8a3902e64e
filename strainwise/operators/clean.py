"""Cleaning: categories, missing flags, role-median fill, target clip, keep-first dedup."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import clip
from ..functions.text import capitalize, recode, strip, title
from ..plans.bounds import materialize, small_side
from ..plans.quantiles import TOTAL, exact_medians
from ..schema import TARGET, TRACKED, WORK_MODES

UNKNOWN = "Unknown"


def clean_work_mode(c="work_mode", mapping=WORK_MODES) -> Column:
    """Canonical mode; names outside ``mapping`` pass through, NULL becomes Unknown."""
    return F.coalesce(recode(capitalize(strip(c)), mapping, keep_others=True), F.lit(UNKNOWN))


def clean_job_role(c="job_role") -> Column:
    return F.coalesce(title(strip(c)), F.lit(UNKNOWN))


def clean_company_size(c="company_size") -> Column:
    return F.coalesce(F.col(c), F.lit("Medium"))


def clean_categories(df: DataFrame) -> DataFrame:
    """Clean whichever of the three category columns the frame has."""
    rules = {"work_mode": clean_work_mode, "job_role": clean_job_role, "company_size": clean_company_size}
    return df.withColumns({c: rule() for c, rule in rules.items() if c in df.columns})


def tracked(df: DataFrame) -> list:
    return [c for c in TRACKED if c in df.columns]


def flag_missing(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{c}_is_missing": F.col(c).isNull().cast("int") for c in tracked(df)})


def impute_role_median(df: DataFrame, by: str = "job_role", **options) -> DataFrame:
    """Fill gaps with the role's median, else the overall median, else 0.

    Two reads of ``df``: one counts values for all medians, one fills.
    """
    columns = tracked(df)
    medians = materialize(exact_medians(df, columns, by=by, with_total=True, **options))
    total = medians.where(TOTAL).first()
    overall = {c: (total[c] if total else None) for c in columns}
    names = {c: f"_m_{c}" for c in columns}
    per_role = medians.where(~F.col(TOTAL)).select(by, *[F.col(c).alias(n) for c, n in names.items()])
    joined = df.join(small_side(per_role, medians.count()), by, "left")
    filled = {c: F.coalesce(c, n, F.lit(0.0 if overall[c] is None else overall[c])) for c, n in names.items()}
    return joined.withColumns(filled).select(*df.columns)


def impute_missing(df: DataFrame, **options) -> DataFrame:
    """Flags first, then the fill."""
    return impute_role_median(flag_missing(df), **options)


def clip_score(df: DataFrame, c: str = TARGET) -> DataFrame:
    return df.withColumn(c, clip(c, 0.0, 10.0)) if c in df.columns else df


def keep_first(df: DataFrame, keys=("employee_id", "source_dataset"), order_by=()) -> DataFrame:
    """First row per key (NULL keys equal each other).

    "First" is by ``order_by``, then by a hash of the remaining columns, so the
    outcome does not depend on how the input is split. ``row_number() = 1`` lets Spark
    keep one candidate per key and task before the shuffle, so a hot key stays cheap.
    """
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    ties = [F.xxhash64(*rest)] if rest else []
    window = Window.partitionBy(*keys).orderBy(*(order_by or ()), *(ties or [F.lit(0)]))
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def preprocess(df: DataFrame, order_by=(), **options) -> DataFrame:
    """The whole cleaning stage, in its fixed order.

    Deduplication picks its row by the cleaned values; give ``order_by`` when the
    source has an arrival order.
    """
    ready = impute_missing(clean_categories(df), **options)
    return keep_first(clip_score(ready), order_by=order_by)


def median_per_role_window(df: DataFrame, c: str, by: str = "job_role", **options) -> DataFrame:
    """Attach the role's median of ``c`` to every row.

    Same result as ``median(c) over (partition by role)`` without putting a whole
    role into one task: the medians are aggregated and joined back.
    """
    medians = materialize(exact_medians(df, [c], by=by, **options).withColumnRenamed(c, f"{c}_{by}_median"))
    right = medians.withColumnRenamed(by, "_by")
    match = F.col(by).eqNullSafe(F.col("_by"))
    return df.join(small_side(right, medians.count()), match, "left").drop("_by")
