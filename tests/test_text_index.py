"""Searches by the index return what the plain filter returns, and read little."""

import pytest
from pyspark.sql import functions as F

from strainwise.operators import text_index as ti
from strainwise.operators.roster import filter_roster
from strainwise.schema import ROSTER
from test_clustered import rows_read

IDS = ["EM1", "em12", "EM123", "xEM12x", "ÄÖÜ7", "äöü77", "İstan", "straße", "STRASSE", "ab😀cd", "😀😀😀", "", "a", "ab", None,
       "100%_x", "e.m", "EM123", "EM123", "aaa", "aaaa"]
CITIES = ["Pune", "New Delhi", "pune ", None, "Zürich", "", "São Paulo"]


def as_roster(df):
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in ROSTER])


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rows = [(i, c, "Low" if k % 2 else "Moderate") for k, (i, c) in enumerate((i, c) for i in IDS for c in CITIES)]
    table = as_roster(spark.createDataFrame(rows, "id string, city string, band string"))
    path = str(tmp_path_factory.mktemp("index") / "small")
    ti.index_roster(table, path, range_rows=40, range_entries=100)
    return table, path


@pytest.mark.parametrize("args", [
    {"search": s} for s in ("EM1", "em123", "m12", "zzz", "e", "em", "", "äÖü", "ÄÖÜ77", "straße", "STRASSE", "ß", "😀😀😀", "B😀C", "😀",
                            "İst", "i̇st", "100%", "%_x", "e.m", "aaa", "aaaa", "aaaaa")
] + [{"city": "une"}, {"city": "ZÜR"}, {"search": "em1", "city": "new delhi"}, {"search": "m", "city": "PUNE"}, {"city": "ã"},
     {"search": "EM123", "band": "Low"}, {"search": "em123", "band": "none such"}, {"search": "em[0-9]", "regex": True}],
    ids=str)
def test_equals_the_scan(spark, small, args, monkeypatch):
    table, path = small
    want = sorted(map(str, filter_roster(table, **args).collect()))
    for share, blocks in ((ti.SCAN_SHARE, ti.MOST_BLOCKS), (1.0, ti.MOST_BLOCKS), (1.0, 0)):
        monkeypatch.setattr(ti, "SCAN_SHARE", share)
        monkeypatch.setattr(ti, "MOST_BLOCKS", blocks)
        found = ti.search_roster(spark, path, **args)
        assert found.columns == table.columns
        assert sorted(map(str, found.collect())) == want


def test_short_texts_and_common_ones_are_scanned(spark, small):
    _, path = small
    assert ti.candidates(spark, path, "em") is None and ti.candidates(spark, path) is None
    assert ti.candidates(spark, path, "zzz").isEmpty()
    assert ti.candidates(spark, path, "aaaa") is not None


def test_a_search_reads_a_small_share(spark, tmp_path):
    n = 60_000
    table = as_roster(spark.range(n).select(
        F.concat(F.lit("EM"), F.col("id") * 7919 % n).alias("id"), F.concat(F.lit("City "), F.md5(F.col("id").cast("string"))).alias("city")))
    path = str(tmp_path / "index")
    ti.index_roster(table, path, range_rows=20_000, range_entries=2_000_000, group_bytes=64 << 10)
    rows = spark.read.parquet(f"{path}/rows")
    for args, most in (({"search": "em4321"}, 2), ({"search": "59999"}, 8)):
        near = ti.candidates(spark, path, **args)
        blocks = [r["_block"] for r in near.select("_block").distinct().collect()]
        assert near.count() < 100 and 0 < len(blocks) <= most
        got = sorted(r["id"] for r in ti.search_roster(spark, path, **args).collect())
        assert got == sorted(r["id"] for r in filter_roster(table, **args).collect()) and got
    # ids that begin alike share blocks; the other row groups are skipped
    assert rows_read(rows.where(F.col("_block") == blocks[0])) < 0.3 * n
    lists = spark.read.parquet(f"{path}/lists")
    assert rows_read(lists.where(F.col("_letters") == "id:999")) < 0.2 * lists.count()
    assert lists.agg(F.max(F.size("places"))).first()[0] <= 1 << ti.BLOCK_BITS
    # all rows hold it: a scan is cheaper
    assert ti.candidates(spark, path, city="city") is None


def test_an_id_held_by_most_rows_fills_several_ranges(spark, tmp_path):
    table = as_roster(spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit("hot id")).alias("id"), F.col("id").cast("string").alias("city")))
    path = str(tmp_path / "hot")
    ti.index_roster(table, path, range_rows=300)
    files = spark.read.parquet(f"{path}/rows").groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 9 and max(r["count"] for r in files) < 700
    assert ti.search_roster(spark, path, search="T I", city="299").count() == filter_roster(table, search="T I", city="299").count() > 0


def test_empty_table(spark, tmp_path):
    table = as_roster(spark.range(0).select(F.col("id").cast("string")))
    ti.index_roster(table, str(tmp_path / "none"))
    assert ti.search_roster(spark, str(tmp_path / "none"), search="abc").collect() == []
    assert ti.search_roster(spark, str(tmp_path / "none")).columns == table.columns
