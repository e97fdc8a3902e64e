"""Roster headers: normal form, required fields, aliases, coverage."""

from pyspark.sql import DataFrame, functions as F

from ..schema import ALIASES, FOREIGN_HEADERS, MODEL_FEATURES, REQUIRED_UPLOAD


def normalize_headers(df: DataFrame) -> DataFrame:
    """Strip, lower case, spaces to underscores. Two headers may not become one."""
    names = [c.strip().lower().replace(" ", "_") for c in df.columns]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError("headers collide after normalisation: " + ", ".join(clash))
    return df.toDF(*names)


def neutral_headers(df: DataFrame) -> DataFrame:
    """Foreign names of the target columns become this library's names."""
    return df.select([F.col(f"`{c}`").alias(FOREIGN_HEADERS.get(c, c)) for c in df.columns])


def require_fields(df: DataFrame, fields=REQUIRED_UPLOAD) -> DataFrame:
    absent = sorted(set(fields) - set(df.columns))
    if absent:
        raise ValueError("the roster lacks these columns: " + ", ".join(absent))
    return df


def alias_of(columns, field: str) -> str | None:
    """The column that plays ``field``; the first listed alias present wins."""
    return next((name for name in ALIASES[field] if name in columns), None)


def resolve_aliases(df: DataFrame) -> DataFrame:
    """Give location, region, gender and id columns their standard names.

    Other columns stay; a losing alias of the same field is kept under its own name,
    unless it already bears the standard name, which then gives way.
    """
    chosen = {field: alias_of(df.columns, field) for field in ALIASES}
    moved = {source: field for field, source in chosen.items() if source}
    beaten = {field for field, source in chosen.items() if source and source != field}
    return df.select([F.col(c).alias(moved.get(c, c)) for c in df.columns
                      if c in moved or c not in beaten])


def coverage(df: DataFrame) -> DataFrame:
    """Which model features and context fields a roster supplies, and how completely.

    One row per field: ``field, kind, supplied, filled, rows``.
    """
    spots = [(f, "required" if f in REQUIRED_UPLOAD else "optional", f if f in df.columns else None)
             for f in MODEL_FEATURES]
    spots += [(f, "context", alias_of(df.columns, f)) for f in ALIASES]
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(c if c else F.lit(None)).alias(f"n_{f}") for f, _, c in spots],
    )
    lines = F.array(*[
        F.struct(F.lit(f).alias("field"), F.lit(kind).alias("kind"), F.lit(c is not None).alias("supplied"),
                 F.col(f"n_{f}").alias("filled"), F.col("rows"))
        for f, kind, c in spots
    ])
    return counts.select(F.inline(lines))
