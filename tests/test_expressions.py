"""Hand-made edge tables for text, numbers and bands."""

import math

import pytest
from pyspark.sql import functions as F

from strainwise.functions import bands, indices, numbers, text
from strainwise.operators import clean


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def apply(spark, values, expr, kind="string"):
    return [r["y"] for r in column(spark, values, kind).select("i", expr.alias("y")).orderBy("i").collect()]


def test_job_role_titles(spark):
    given = ["full-stack dev", "o'neil", "QA engineer", "b2b  sales/ops", "\t padded \n", None]
    want = ["Full-Stack Dev", "O'Neil", "Qa Engineer", "B2B  Sales/Ops", "Padded", "Unknown"]
    assert apply(spark, given, clean.clean_job_role("x")) == want
    assert want[:4] == [g.strip().title() for g in given[:4]]


def test_work_modes(spark):
    given = ["ON-SITE", " home ", "Office", "In-Office", "wfh", None, "hybrid"]
    want = ["Onsite", "Remote", "Onsite", "In-office", "Wfh", "Unknown", "Hybrid"]
    assert apply(spark, given, clean.clean_work_mode("x")) == want


def test_numbers_are_read_strictly(spark):
    given = ["1e3", " 4 ", "0x10", "1_000", "5d", "inf", "abc", "-.5", "", None, "1e999"]
    want = [1000.0, 4.0, None, None, None, None, None, -0.5, None, None, None]
    assert apply(spark, given, text.as_number("x")) == want


def test_clip_and_bands(spark):
    given = [-1.0, 2.5, 4.5, 10.9, None, 2.4999]
    assert apply(spark, given, numbers.clip("x", 0.0, 10.0), "double") == [0.0, 2.5, 4.5, 10.0, None, 2.4999]
    want = ["Low", "Moderate", "Elevated", "Elevated", None, "Low"]
    assert apply(spark, given, bands.risk_band("x"), "double") == want
    assert apply(spark, [7.5, 5.5, 4.5, 2.5, 0.0, None], bands.risk_band5("x"), "double") == [
        "CRITICAL", "HIGH", "ELEVATED", "MODERATE", "LOW", None]


def test_nan_becomes_null(spark):
    df = numbers.nan_to_null(column(spark, [float("nan"), 1.0, None], "double"))
    assert [r["x"] for r in df.orderBy("i").collect()] == [None, 1.0, None]


def test_elevated_rate_counts_null_rows(spark):
    df = column(spark, [-1.0, 2.5, 4.5, 10.9, None, None], "double")
    assert df.agg(numbers.share(F.col("x") >= 4.5).alias("r")).first()["r"] == 33.3


def test_hours_bands(spark):
    given = [-1.0, 0.0, 35.0, 35.5, 40.0, 40.5, 999.0, 1000.0, None]
    got = apply(spark, given, bands.hours_band("x"), "double")
    assert got == [None, None, "Undertime (<35h)", "Standard (35–40h)", "Standard (35–40h)", "Overtime (41–50h)",
                   "Extreme (>60h)", None, "Standard (35–40h)"]


def test_advice_tiers(spark):
    sizes = [None if a is None else len(a) for a in apply(spark, [6.0, 5.9, 4.4, None], bands.advice("x"), "double")]
    assert sizes == [4, 3, 2, None]


@pytest.mark.parametrize("scale", [100.0, 10.0])
def test_indices_by_hand(spark, scale):
    unit = scale / 100.0
    row = spark.createDataFrame(
        [(50.0, 5.0, 4.0, 3.0, 12.0, 7.0, 50.0 * unit, 80.0 * unit, 60.0 * unit)],
        "work_hours_per_week double, overtime_hours double, meetings_per_day double, deadlines_missed double, "
        "sleep_hours double, physical_activity_days double, work_life_balance double, job_satisfaction double, manager_support double")
    got = indices.with_indices(row, scale).first()
    assert math.isclose(got["workload_index"], 100 * (0.4 * 1.25 + 0.3 * 0.5 + 0.2 * 0.8 + 0.1))
    assert math.isclose(got["wellness_score"], 100 * (0.3 * 1.2 + 0.2 + 0.3 * 0.5 + 0.2 * 0.8))
    assert math.isclose(got["support_index"], 60.0) and math.isclose(got["meeting_load"], 4 / 3)


def test_indices_keep_null(spark):
    row = spark.sql("select cast(null as double) sleep_hours, 1d physical_activity_days, 2d work_life_balance, 3d job_satisfaction")
    assert row.select(indices.wellness_score().alias("w")).first()["w"] is None
