"""Stored layouts for single lookups and deep pages: what is read does not grow with the table.

``store_by_id`` keeps rows in ranges of their normal id, with Bloom filters, so that a lookup
opens the row groups that may hold the id. ``store_by_rank`` keeps rows in ranges of a
sort order with the number of rows before each, so that a page reads the ranges it lies in.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..schema import ID_COLUMNS
from .clean import keep_first
from .roster import _order, normal_id

# Rows of one range, and bytes of a row group inside it.
RANGE_ROWS = 1_000_000
GROUP_BYTES = 8 << 20
# A lookup by filter; more ids are a join (``roster.lookup``).
MOST_IDS = 200


def store_by_id(tables: dict, path: str, range_rows: int = RANGE_ROWS, group_bytes: int = GROUP_BYTES) -> None:
    """Write the rows of the named tables below ``path``, one line per id column a row has.

    Tables earlier in the dict win a lookup. Columns are united by name. Lines without an id are left out.
    """
    parts = []
    for place, (name, df) in enumerate(tables.items()):
        idents = [c for c in ID_COLUMNS if c in df.columns]
        each = F.explode(F.array(*[F.struct(normal_id(c).alias("key"), F.lit(i).alias("turn")) for i, c in enumerate(idents)])).alias("_id")
        rows = df.select(each, "*").withColumns({"_key": F.col("_id.key"), "_turn": F.col("_id.turn"), "_place": F.lit(place), "_in": F.lit(name)})
        parts.append(rows.drop("_id").where("_key is not null"))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    ranges = int(rows.count() // range_rows + 1)
    (rows.repartitionByRange(ranges, "_key").sortWithinPartitions("_key", "_place", "_turn").write
     .option("parquet.block.size", str(group_bytes)).option("parquet.bloom.filter.enabled#_key", "true")
     .option("parquet.bloom.filter.expected.ndv#_key", str(min(range_rows, max(1024, group_bytes // 64)))).parquet(path))


def candidates(spark: SparkSession, path: str, keys) -> DataFrame:
    """Stored lines of a few normal ids: equality filters reach statistics and Bloom filters of the files."""
    keys = sorted({k for k in keys if k is not None})
    if len(keys) > MOST_IDS:
        raise ValueError(f"more than {MOST_IDS} ids: use roster.lookup, which joins")
    wanted = reduce(lambda a, b: a | b, [F.col("_key") == k for k in keys], F.lit(False)) if keys else F.lit(False)
    return spark.read.parquet(path).where(wanted)


def find_by_id(spark: SparkSession, path: str, ids, order_by=()) -> DataFrame:
    """Rows of up to 200 asked ids, as :func:`roster.lookup` gives them: stripped, any case, first table and id column first.

    Every distinct asked id comes back; ``found_in`` is the table's name or NULL.
    """
    asked = spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string").withColumn("_key", normal_id("id"))
    keys = [r["_key"] for r in asked.select("_key").distinct().collect()]  # at most MOST_IDS
    first = keep_first(candidates(spark, path, keys), keys=["_key"], order_by=["_place", "_turn", *order_by])
    first = first.withColumnRenamed("_in", "found_in").drop("_place", "_turn")
    return asked.join(first, "_key", "left").drop("_key")


def store_by_rank(table: DataFrame, path: str, sort_col: str = "score", sort_dir: str = "desc", range_rows: int = RANGE_ROWS) -> None:
    """Write a roster table below ``path`` in ranges of its sort order, and the ranks at which they begin."""
    order = _order(sort_col, sort_dir == "asc")
    ranges = int(table.count() // range_rows + 1)
    dealt = table.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    table.limit(0).write.parquet(f"{path}/columns")  # an empty table has no ranges, but columns
    dealt.sortWithinPartitions(*order).write.partitionBy("_range").parquet(f"{path}/rows")
    kept = table.sparkSession.read.schema(dealt.schema).parquet(f"{path}/rows")
    line = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per range
    sizes = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("rows"))
    sizes.select("_range", "rows", (F.sum("rows").over(line) - F.col("rows")).alias("first"), F.lit(sort_col).alias("sort_col"),
                 F.lit(sort_dir).alias("sort_dir")).coalesce(1).write.parquet(f"{path}/ranks")


def page_by_rank(spark: SparkSession, path: str, page: int = 0, page_size: int = 25) -> DataFrame:
    """One page (size 1 to 200) of a table stored by rank: only the ranges that hold its ranks are read and sorted."""
    size = max(1, min(page_size, 200))
    start = max(0, page) * size
    hit = spark.read.parquet(f"{path}/ranks").where(
        (F.col("first") < start + size) & (F.col("first") + F.col("rows") > start)).orderBy("_range").collect()  # a page spans few ranges
    none = spark.read.parquet(f"{path}/columns")
    if not hit:
        return none
    rows = spark.read.schema(T.StructType([*none.schema, T.StructField("_range", T.IntegerType())])).parquet(f"{path}/rows").where(
        F.col("_range").isin([r["_range"] for r in hit])).drop("_range")
    return rows.orderBy(*_order(hit[0]["sort_col"], hit[0]["sort_dir"] == "asc")).offset(start - hit[0]["first"]).limit(size)
