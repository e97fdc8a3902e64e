"""File streams give the batch results."""

import pytest
from pyspark.sql import functions as F

from strainwise.operators import breakdown as bd, scoring
from strainwise.registry import catalog
from strainwise.sources import sinks
from strainwise.streaming import roster_stream


@pytest.fixture(scope="module")
def files(spark, sf, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stream"))
    roster = catalog.roster(spark, sf)
    sinks.export_csv(roster.repartition(5), f"{folder}/in")
    return folder, roster


def stream(spark, sf, folder, schema):
    rows = roster_stream.read_roster_stream(spark, f"{folder}/in", schema, files_per_trigger=2)
    return roster_stream.score_stream(rows, catalog.defaults(spark, sf), catalog.scorer(spark, sf))


def test_scored_files_equal_the_batch(spark, sf, files):
    folder, roster = files
    run = roster_stream.append_scored(stream(spark, sf, folder, roster.schema), f"{folder}/out", f"{folder}/state")
    run.awaitTermination()
    key = ["employee_id", F.round("score", 6).alias("score"), "band"]
    got = spark.read.parquet(f"{folder}/out").select(*key)
    want = scoring.score_roster(roster, catalog.defaults(spark, sf), catalog.scorer(spark, sf)).select(*key)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    # a restart finds nothing new
    again = roster_stream.append_scored(stream(spark, sf, folder, roster.schema), f"{folder}/out", f"{folder}/state")
    again.awaitTermination()
    assert spark.read.parquet(f"{folder}/out").count() == got.count()


def test_running_breakdown_equals_the_batch(spark, sf, files):
    folder, roster = files
    scored = stream(spark, sf, folder, roster.schema)
    run = roster_stream.running_breakdown(scored, "job_role", f"{folder}/groups", f"{folder}/groups_state")
    run.awaitTermination()
    assert len(run.recentProgress) >= 3  # several micro-batches
    want = bd.breakdown(scoring.score_roster(roster, catalog.defaults(spark, sf), catalog.scorer(spark, sf)), "job_role", limit=None)
    assert sorted(map(tuple, roster_stream.latest_breakdown(spark, f"{folder}/groups").collect())) == sorted(map(tuple, want.collect()))


def test_running_reports_equal_their_batch_forms_after_a_restart(spark, sf, tmp_path):
    roster = catalog.roster(spark, sf)
    folder = str(tmp_path)
    parts = roster.withColumn("city", F.when(F.col("work_hours_per_week") % 2 < 1, F.col("city"))).randomSplit([1.0, 1.0], 3)
    for n, part in enumerate(parts):
        sinks.export_csv(part.repartition(3), f"{folder}/in{n}")
    reader = lambda: roster_stream.read_roster_stream(spark, f"{folder}/in*", roster.schema, files_per_trigger=2)
    settings = catalog.defaults(spark, sf), catalog.scorer(spark, sf)
    located = lambda: bd.with_state(roster_stream.score_stream(reader(), *settings), city="city")
    (tmp_path / "in1").rename(tmp_path / "later")
    roster_stream.running_reports(located(), f"{folder}/out", f"{folder}/state").awaitTermination()
    first = roster_stream.latest_report(spark, f"{folder}/out", "fleet").first()["employees"]
    (tmp_path / "later").rename(tmp_path / "in1")
    roster_stream.running_reports(located(), f"{folder}/out", f"{folder}/state").awaitTermination()
    batch = bd.with_state(scoring.score_roster(
        spark.read.schema(roster.schema).option("header", True).csv([f"{folder}/in0", f"{folder}/in1"]), *settings), city="city")
    want = {"roles": bd.breakdown(batch, "job_role"), "modes": bd.breakdown(batch, "work_mode"),
            "cities": bd.breakdown(batch, "city"), "states": bd.breakdown_state(batch),
            "hours": bd.breakdown_hours(batch), "fleet": bd.fleet_summary(batch)}
    for report, rows in want.items():
        got = roster_stream.latest_report(spark, f"{folder}/out", report)
        assert got.columns == rows.columns, report
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect())), report
    assert 0 < first < want["fleet"].first()["employees"]


def test_required_fields_are_checked(spark, files):
    folder, roster = files
    with pytest.raises(ValueError, match="lacks these columns: overtime_hours"):
        roster_stream.read_roster_stream(spark, f"{folder}/in", roster.drop("overtime_hours").schema)


def test_a_file_with_other_headers_stops_the_stream(spark, sf, files, tmp_path):
    _, roster = files
    roster.withColumnRenamed("overtime_hours", "extra").coalesce(1).write.option("header", True).csv(str(tmp_path / "in"))
    run = roster_stream.append_scored(stream(spark, sf, str(tmp_path), roster.schema), str(tmp_path / "out"), str(tmp_path / "state"))
    with pytest.raises(Exception):
        run.awaitTermination()
