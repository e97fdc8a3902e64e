"""Substring search of roster ids and cities by an index of three-letter sequences.

``index_roster`` stores the rows in numbered blocks and, per three letters and block, the
places that hold them. ``search_roster`` intersects the lists of the rarest sequences of the asked text
and applies the plain filter to the rows left, so that it returns what ``filter_roster`` returns.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.bounds import materialize, small_side
from .roster import filter_roster

INDEXED = ("id", "city")
# Rows of a block: a list of places is never longer.
BLOCK_BITS = 12
# Lists intersected by a search; longer texts are settled by the filter.
MOST_LISTS = 4
# Where even the rarest sequence is held by a larger share of the rows, the rows are scanned.
SCAN_SHARE = 0.25
# Up to this many blocks are asked for by number, which skips the other row groups.
MOST_BLOCKS = 200


def _letters(c: str) -> Column:
    """Distinct three-letter sequences of a lower-cased column, marked with its name; none for NULL."""
    letters = F.split(F.lower(c), "")  # whole characters
    starts = F.sequence(F.lit(0), F.size(letters) - 3)
    each = F.transform(starts, lambda i: F.concat(F.lit(f"{c}:"), F.get(letters, i), F.get(letters, i + 1), F.get(letters, i + 2)))
    return F.when(F.size(letters) >= 3, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def asked_letters(c: str, text: str) -> set:
    low = text.lower()
    return {f"{c}:{low[i:i + 3]}" for i in range(len(low) - 2)}


def index_roster(table: DataFrame, path: str, range_rows: int = 1_000_000, range_entries: int = 10_000_000,
                 group_bytes: int = 8 << 20) -> None:
    """Write a roster table and its index below ``path``.

    Rows lie in ranges of their id, so that ids that begin alike share blocks; equal ids are dealt
    by their place in a stored copy and may fill several ranges. A sequence that all rows hold is
    dealt by block, never gathered in one task.
    """
    spark, kept = table.sparkSession, materialize(table)
    total = kept.count()
    order = [F.asc_nulls_last("id"), F.asc("_turn")]
    dealt = kept.withColumn("_turn", F.monotonically_increasing_id()).repartitionByRange(int(total // range_rows + 1), *order)
    line = dealt.sortWithinPartitions(*order).withColumn("_turn", F.monotonically_increasing_id())
    rows = line.withColumns({"_block": F.shiftright("_turn", BLOCK_BITS),
                             "_place": F.col("_turn").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")}).drop("_turn")
    rows.write.option("parquet.block.size", str(group_bytes)).parquet(f"{path}/rows")
    held = F.concat(*[_letters(c) for c in INDEXED])
    stored = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    entries = stored.agg(F.sum(F.size(held))).first()[0] or 0
    lists = (stored.select("_block", "_place", F.explode(held).alias("_letters"))
             .repartitionByRange(int(entries // range_entries + 1), "_letters", "_block")
             .groupBy("_letters", "_block").agg(F.sort_array(F.collect_list("_place")).alias("places")))
    (lists.sortWithinPartitions("_letters", "_block").write.option("parquet.block.size", str(group_bytes))
     .parquet(f"{path}/lists"))
    sizes = spark.read.schema(lists.schema).parquet(f"{path}/lists").groupBy("_letters").agg(F.sum(F.size("places")).alias("rows"))
    sizes.orderBy("_letters").write.parquet(f"{path}/sizes")
    spark.range(1).select(F.lit(total).cast("long").alias("rows")).write.parquet(f"{path}/facts")


def candidates(spark: SparkSession, path: str, search: str = "", city: str = "") -> DataFrame | None:
    """Stored rows that may match, or None where the index does not help (short or very common texts)."""
    wanted = sorted(asked_letters("id", search) | asked_letters("city", city))
    if not wanted:
        return None
    rows = spark.read.parquet(f"{path}/rows")
    sizes = spark.read.schema("_letters string, rows long").parquet(f"{path}/sizes")
    held = {r["_letters"]: r["rows"] for r in sizes.where(F.col("_letters").isin(wanted)).collect()}  # one line per asked sequence
    if len(held) < len(wanted):
        return rows.where("false")
    rarest = sorted(wanted, key=lambda g: (held[g], g))[:MOST_LISTS]
    if held[rarest[0]] > SCAN_SHARE * spark.read.parquet(f"{path}/facts").first()["rows"]:
        return None
    lists = spark.read.parquet(f"{path}/lists").where(F.col("_letters").isin(rarest))
    # a block has at most one list per sequence: the state is bounded by the block
    met = lists.groupBy("_block").agg(F.collect_list("places").alias("each")).where(F.size("each") == len(rarest))
    common = F.aggregate("each", F.get("each", F.lit(0)), F.array_intersect)
    hits = materialize(met.select("_block", common.alias("places")).where(F.size("places") > 0))
    found = hits.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum(F.size("places")), F.lit(0)).alias("rows")).first()
    if not found["blocks"]:
        return rows.where("false")
    if found["blocks"] <= MOST_BLOCKS:
        blocks = [r["_block"] for r in hits.select("_block").collect()]
        rows = rows.where(reduce(lambda a, b: a | b, [F.col("_block") == b for b in blocks]))
    single = hits.select("_block", F.explode("places").alias("_place"))
    return rows.join(small_side(single, found["rows"]), ["_block", "_place"], "left_semi")


def search_roster(spark: SparkSession, path: str, search: str = "", city: str = "", regex: bool = False, **others) -> DataFrame:
    """:func:`filter_roster` over an indexed table: same arguments, same rows.

    Patterns, texts of one or two letters and texts that too many rows hold scan the stored rows.
    """
    near = None if regex else candidates(spark, path, search, city)
    rows = spark.read.parquet(f"{path}/rows") if near is None else near
    return filter_roster(rows, search=search, city=city, regex=regex, **others).drop("_block", "_place")
