"""Roster table: projection, filters, sorting, pages, id lookup, metadata."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import as_number, normal_id
from ..plans.bounds import MAX_BROADCAST_ROWS, small_side
from ..schema import BANDS, DEFAULT_THRESHOLD, ID_COLUMNS, METADATA_FIELDS, MODEL_FEATURES, ROSTER
from ..sources.headers import alias_of
from .align import align
from .breakdown import with_state
from .clean import keep_first
from .scoring import Scorer, score_features

def roster_table(scored: DataFrame) -> DataFrame:
    """The 13 roster columns of a scored roster. Missing text is '', a missing id NULL."""
    have = dict(scored.dtypes)
    city, region = alias_of(have, "city"), alias_of(have, "state")
    df = with_state(scored, region, city, name="_state")

    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")

    def number(c):
        if c not in have:
            return F.lit(None).cast("double")
        return F.round(as_number(c) if have[c] == "string" else F.col(c).cast("double"), 1)

    def named(field):
        return alias_of(have, field) or ""

    ident = named("employee_id")
    return df.select(
        (F.col(ident).cast("string") if ident else F.lit(None).cast("string")).alias("id"),
        text("job_role").alias("role"),
        text("work_mode").alias("mode"),
        text(named("city")).alias("city"),
        F.coalesce("_state", F.lit("")).alias("state"),
        text(named("gender")).alias("gender"),
        number("work_hours_per_week").alias("hours"),
        number("stress_level").alias("stress"),
        number("overtime_hours").alias("overtime"),
        number("experience_years").alias("experience"),
        F.round("score", 2).alias("score"),
        F.round(F.col("probability") * 100.0, 1).alias("prob"),
        F.col("band"),
    )


def _contains(c: str, text: str, regex: bool) -> Column:
    if regex:
        return F.col(c).rlike("(?i)" + text)
    return F.contains(F.lower(c), F.lit(text.lower()))


def filter_roster(table: DataFrame, search: str = "", band: str = "", role: str = "", mode: str = "",
                  city: str = "", regex: bool = False) -> DataFrame:
    """All given conditions must hold; an unknown band name is ignored.

    ``search`` (id) and ``city`` are case-insensitive substrings, or patterns
    with ``regex``.
    """
    if search:
        table = table.where(_contains("id", search, regex))
    if band in BANDS:
        table = table.where(F.col("band") == band)
    if role:
        table = table.where(F.col("role") == role)
    if mode:
        table = table.where(F.col("mode") == mode)
    if city:
        table = table.where(_contains("city", city, regex))
    return table


def _order(sort_col: str, ascending: bool) -> list:
    """Sort keys; every column takes part so that the order is total."""
    first = sort_col if sort_col in ROSTER else "score"
    head = F.asc_nulls_last(first) if ascending else F.desc_nulls_last(first)
    return [head, F.asc_nulls_last("id"), *[F.asc_nulls_last(c) for c in ROSTER if c not in (first, "id")]]


def sort_roster(table: DataFrame, sort_col: str = "score", sort_dir: str = "desc") -> DataFrame:
    """Whole table in order; an unknown column sorts by score, NULLs are last both ways."""
    return table.orderBy(*_order(sort_col, sort_dir == "asc"))


def roster_page(table: DataFrame, page: int = 0, page_size: int = 25, sort_col: str = "score",
                sort_dir: str = "desc") -> DataFrame:
    """One page of the sorted table (page size 1 to 200).

    Meant for the first pages: Spark keeps page * size + size rows per task. Use
    :func:`roster_page_after` to walk deep into a big table.
    """
    size = max(1, min(page_size, 200))
    return sort_roster(table, sort_col, sort_dir).offset(max(0, page) * size).limit(size)


def roster_page_after(table: DataFrame, last_value, last_id: str, page_size: int = 25,
                      sort_col: str = "score", sort_dir: str = "desc") -> DataFrame:
    """Page that follows the row (``last_value``, ``last_id``); cost does not grow with depth.

    Needs unique ids.
    """
    c = F.col(sort_col if sort_col in ROSTER else "score")
    value = F.lit(last_value)
    later_id = F.col("id") > F.lit(last_id)
    if last_value is None:
        rest = c.isNull() & later_id
    else:
        beyond = c > value if sort_dir == "asc" else c < value
        rest = beyond | c.isNull() | ((c == value) & later_id)
    return roster_page(table.where(rest), 0, page_size, sort_col, sort_dir)


def distinct_sorted(table: DataFrame, c: str) -> DataFrame:
    return table.where(F.col(c).isNotNull()).select(c).distinct().orderBy(c)


def lookup(ids: DataFrame, roster: DataFrame, master: DataFrame, order_by=(), many_ids: int | None = None) -> DataFrame:
    """Rows of the asked ids (column ``id``): roster before master, first row wins.

    Every id column present is searched, in the listed order: a match in an earlier one
    wins. Ids match stripped and case-insensitively. Every asked id comes back;
    ``found_in`` is 'roster', 'master' or NULL. ``many_ids`` is a known bound of the
    number of ids; the ids are broadcast only when it is small.
    """
    asked = ids.select("id", normal_id("id").alias("_key")).distinct()
    keys = asked.select("_key").distinct()
    if many_ids is not None:
        keys = small_side(keys, many_ids, MAX_BROADCAST_ROWS)
    sides = [(roster, "roster"), (master, "master")]
    shared = [c for c in roster.columns if c in master.columns]
    extra = [c for c in roster.columns if c not in shared]
    parts = []
    for place, (df, name) in enumerate(sides):
        idents = [c for c in ID_COLUMNS if c in df.columns]
        if not idents:
            continue
        kept = [c for c in shared + extra if c in df.columns]
        each = F.explode(F.array(*[F.struct(normal_id(c).alias("key"), F.lit(i).alias("rank"))
                                   for i, c in enumerate(idents)])).alias("_id")
        rows = df.select(each, *kept).select(F.col("_id.key").alias("_key"), F.col("_id.rank").alias("_turn"),
                                             F.lit(place).alias("_place"), F.lit(name).alias("found_in"), *kept)
        parts.append(rows.where("_key is not null").join(keys, "_key", "left_semi"))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    first = keep_first(rows, keys=["_key"], order_by=["_place", "_turn", *order_by]).drop("_place", "_turn")
    return asked.join(first, "_key", "left").drop("_key")


def metadata(df: DataFrame, fields=METADATA_FIELDS) -> Column:
    """Map of the descriptive fields that are present and not empty."""
    have = [c for c in fields if c in df.columns]
    pairs = [x for c in have for x in (F.lit(c), F.col(c).cast("string"))]
    entries = F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")
    return F.map_filter(entries, lambda k, v: v.isNotNull() & ~v.isin("nan", "None", ""))


def employee_report(found: DataFrame, defaults: dict, scorer: Scorer,
                    threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Features, metadata, score and band of looked-up rows; misses are dropped."""
    hits = found.where(F.col("found_in").isNotNull())
    hits = hits.withColumns({"metadata": metadata(hits)})
    filled = align(hits, defaults, keep=["id", "found_in", "metadata"])
    scored = score_features(filled, scorer, threshold)
    return scored.select(
        "id", "found_in", F.struct(*[c for c in MODEL_FEATURES]).alias("features"), "metadata",
        F.round("score", 2).alias("strain_score"),
        F.round(F.col("probability") * 100.0, 1).alias("elevated_risk_probability"),
        F.col("band").alias("risk_band"),
        F.lit(float(threshold)).alias("threshold"),
    )
