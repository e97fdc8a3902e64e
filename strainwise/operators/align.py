"""Defaults of the master table and rosters or scenarios filled with them."""

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.text import as_number
from ..plans.bounds import one_row
from ..plans.quantiles import exact_medians
from ..schema import MODEL_CATEGORICAL, MODEL_FEATURES, MODEL_NUMERIC


def modes(df: DataFrame, columns, fallback: str = "Unknown") -> DataFrame:
    """Most frequent text per column (smallest on ties), one row.

    Values are counted first, so a value held by most rows is one row per task.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v"))
                                for c in columns]))
    counts = df.select(pairs.alias("p")).where("p.v is not null").groupBy("p.k", "p.v").agg(
        F.count(F.lit(1)).alias("n"))
    return counts.agg(*[
        F.coalesce(F.min(F.when(F.col("k") == c, F.struct((-F.col("n")).alias("n"), "v")))["v"],
                   F.lit(fallback)).alias(c) for c in columns])


def default_features(master: DataFrame, numeric=MODEL_NUMERIC, categorical=MODEL_CATEGORICAL, **options) -> DataFrame:
    """One row: exact medians of the numeric and modes of the text features."""
    medians = exact_medians(master, numeric, **options)
    texts = one_row(modes(master, categorical))
    return medians.select(*numeric, *[F.lit(texts[c]).alias(c) for c in categorical])


def fit_defaults(master: DataFrame, **options) -> dict:
    """The row of :func:`default_features`, fitted once and passed around."""
    return one_row(default_features(master, **options))


def align(roster: DataFrame, defaults: dict, keep=()) -> DataFrame:
    """Model features of every roster row, gaps and absent columns from ``defaults``.

    Numeric text is read strictly; anything else counts as missing. ``keep`` names
    extra columns to carry along unchanged.
    """
    numeric = [c for c in defaults if c not in MODEL_CATEGORICAL]
    values = {c: F.lit(v).cast("double" if c in numeric else "string") for c, v in defaults.items()}
    types = {f.name: f.dataType for f in roster.schema}

    def filled(c):
        if c not in types:
            return values[c].alias(c)
        if c in numeric:
            given = F.col(c).cast("double") if isinstance(types[c], T.NumericType) else as_number(c)
            return F.coalesce(given, values[c]).alias(c)
        return F.coalesce(F.col(c).cast("string"), values[c]).alias(c)

    carried = [c for c in keep if c in types and c not in MODEL_FEATURES]
    return roster.select(*carried, *[filled(c) for c in defaults])


def fill_scenarios(scenarios: DataFrame, defaults: dict, keep=()) -> DataFrame:
    """Like :func:`align`, with empty text also counting as not given."""
    blank = {c: F.when(F.col(c).cast("string") != "", F.col(c)) for c in MODEL_FEATURES
             if c in scenarios.columns}
    return align(scenarios.withColumns(blank), defaults, keep)

