"""Lookups and pages on stored layouts equal the plain ones and read little."""

import pytest
from pyspark.sql import functions as F

from strainwise.operators import clustered, roster as ro
from strainwise.registry import catalog


def rows_read(df):
    """Rows that left the file scans of a collected DataFrame without exchanges."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.length()))


@pytest.fixture(scope="module")
def people(spark):
    n = 60_000
    return spark.range(n).select(
        F.concat(F.lit("EM"), F.col("id") * 7919 % n).alias("employee_id"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit(" Alt"), F.col("id"))).alias("emp_id"),
        F.md5(F.col("id").cast("string")).alias("job_role"), (F.col("id") % 50).cast("double").alias("work_hours_per_week"))


def test_lookup_reads_a_small_share(spark, people, tmp_path):
    master = people.select("employee_id", F.lit("old").alias("job_role")).unionByName(
        spark.createDataFrame([("EX1", "m")], "employee_id string, job_role string"))
    path = str(tmp_path / "ids")
    clustered.store_by_id({"roster": people, "master": master}, path, range_rows=20_000, group_bytes=64 << 10)
    total = spark.read.parquet(path).count()
    assert total == 60_000 + 20_000 + 60_001
    assert rows_read(clustered.candidates(spark, path, ["em123"])) < 0.1 * total
    # within the ids' range, but absent: the Bloom filter tells
    assert rows_read(clustered.candidates(spark, path, ["em123x"])) < 0.1 * total
    ids = [" em5 ", "ALT9", "Ex1", "nobody", None, "em5", "EM5"]
    got = {r["id"]: r for r in clustered.find_by_id(spark, path, ids, ["job_role"]).collect()}
    asked = spark.createDataFrame([(i,) for i in ids], "id string")
    want = {r["id"]: r for r in ro.lookup(asked, people, master, ["job_role"]).collect()}
    assert set(got) == set(want)
    for i in want:
        assert (got[i]["found_in"], got[i]["job_role"], got[i]["employee_id"]) == (want[i]["found_in"], want[i]["job_role"], want[i]["employee_id"])
    with pytest.raises(ValueError, match="more than"):
        clustered.candidates(spark, path, [str(i) for i in range(1000)])
    assert clustered.candidates(spark, path, []).isEmpty()


@pytest.mark.parametrize("sort_col,sort_dir", [("hours", "asc"), ("experience", "desc"), ("id", "asc")])
def test_pages_by_rank_equal_offsets(spark, sf, tmp_path, sort_col, sort_dir):
    table = ro.roster_table(catalog.scored(spark, sf))
    path = str(tmp_path / "ranks")
    clustered.store_by_rank(table, path, sort_col, sort_dir, range_rows=150)
    n = table.count()
    for page in (0, 1, 7, n // 40, n // 40 + 5):
        assert clustered.page_by_rank(spark, path, page, 40).collect() == ro.roster_page(table, page, 40, sort_col, sort_dir).collect()
    assert clustered.page_by_rank(spark, path, 2, 1000).count() == 200


def test_a_deep_page_reads_few_ranges(spark, people, tmp_path):
    table = people.select(*[(F.col("employee_id") if c == "id" else F.col("work_hours_per_week") if c == "hours" else F.lit(None).cast("string")).alias(c) for c in ro.ROSTER])
    path = str(tmp_path / "deep")
    clustered.store_by_rank(table, path, "hours", "asc", range_rows=3000)
    sizes = [r["rows"] for r in spark.read.parquet(f"{path}/ranks").collect()]
    for page in (0, 1000):
        page_ = clustered.page_by_rank(spark, path, page, 50)
        assert page_.count() == 50
        read = spark.read.parquet(f"{path}/rows").where(F.col("_range") == 0)
        assert read.count() <= max(sizes) and len(page_.inputFiles()) <= 40
        assert page_.collect() == ro.sort_roster(table, "hours", "asc").offset(page * 50).limit(50).collect()


def test_empty_rank_store(spark, sf, tmp_path):
    table = ro.roster_table(catalog.scored(spark, sf)).where("false")
    clustered.store_by_rank(table, str(tmp_path / "none"))
    assert clustered.page_by_rank(spark, str(tmp_path / "none")).collect() == []
