import math

import pytest
from pyspark.sql import functions as F

from strainwise.operators import breakdown as bd, policy, roster as ro, scoring
from strainwise.registry import catalog
from strainwise.schema import HOURS_BANDS, POLICIES, STRAIN_WEIGHTS


@pytest.fixture(scope="module")
def table(spark, sf):
    return ro.roster_table(catalog.scored(spark, sf)).cache()


def test_bands_partition_the_roster(spark, sf, table):
    n = table.count()
    one = bd.fleet_summary(catalog.scored(spark, sf)).first()
    assert one["employees"] == n == one["low"] + one["moderate"] + one["elevated"]
    for rows in (bd.breakdown(catalog.scored(spark, sf), "job_role", limit=None),
                 bd.breakdown(catalog.scored(spark, sf), "gender", limit=None)):
        assert rows.agg(F.sum("employees")).first()[0] == n
    assert bd.breakdown_hours(catalog.scored(spark, sf)).agg(F.sum("employees")).first()[0] == n
    assert len(HOURS_BANDS) == 5


def test_pages_cover_the_table_in_order(table):
    whole = [r["id"] for r in ro.sort_roster(table, "experience", "asc").collect()]
    paged = [r["id"] for p in range(4) for r in ro.roster_page(table, p, 60, "experience", "asc").collect()]
    assert paged == whole[:240]
    walked, last = [], None
    for _ in range(4):
        page = (ro.roster_page(table, 0, 60, "experience", "asc") if last is None
                else ro.roster_page_after(table, last["experience"], last["id"], 60, "experience", "asc")).collect()
        walked += [r["id"] for r in page]
        last = page[-1]
    assert walked == whole[:240]


def test_nulls_are_last_both_ways(table):
    for way in ("asc", "desc"):
        values = [r["overtime"] for r in ro.sort_roster(table, "overtime", way).collect()]
        gaps = [v is None for v in values]
        assert any(gaps) and gaps == sorted(gaps)


def test_walking_through_nulls(table):
    whole = [r["id"] for r in ro.sort_roster(table, "overtime").collect()]
    some = ro.sort_roster(table, "overtime").collect()
    last_number = max(i for i, r in enumerate(some) if r["overtime"] is not None)
    row = some[last_number]
    page = ro.roster_page_after(table, row["overtime"], row["id"], 10, "overtime").collect()
    assert [r["id"] for r in page] == whole[last_number + 1: last_number + 11]
    nxt = ro.roster_page_after(table, None, page[-1]["id"], 10, "overtime").collect()
    assert [r["id"] for r in nxt] == whole[last_number + 11: last_number + 21]


def test_page_size_and_unknown_column(table):
    assert ro.roster_page(table, 0, 5000).count() == 200 and ro.roster_page(table, -3, 0).count() == 1
    top = ro.roster_page(table, 0, 5, "no such column").collect()
    assert [r["score"] for r in top] == sorted((r["score"] for r in top), reverse=True)


def test_filters(table):
    n = table.count()
    assert ro.filter_roster(table, band="nonsense").count() == n
    assert ro.filter_roster(table, search="EM1").count() == ro.filter_roster(table, search="em1").count() > 0
    # a dot is a dot, unless patterns are asked for
    assert ro.filter_roster(table, search="e.1").count() == 0
    assert ro.filter_roster(table, search="e.1", regex=True).count() > 0
    both = ro.filter_roster(table, role="DevOps", mode="remote", band="Low")
    assert {(r["role"], r["mode"], r["band"]) for r in both.collect()} <= {("DevOps", "remote", "Low")}


def test_lookup_priority_and_misses(spark):
    roster = spark.createDataFrame([(" A1 ", 1, "x"), ("a1", 2, "y")], "emp_id string, n int, job_role string")
    master = spark.createDataFrame([("A1", "m", 5.0), ("b2", "m2", 6.0)], "employee_id string, job_role string, sleep_hours double")
    ids = spark.createDataFrame([("a1",), ("B2 ",), ("zz",), (None,)], "id string")
    got = {r["id"]: r for r in ro.lookup(ids, roster, master, order_by=["n"], many_ids=4).collect()}
    assert (got["a1"]["found_in"], got["a1"]["n"], got["a1"]["job_role"]) == ("roster", 1, "x")
    assert (got["B2 "]["found_in"], got["B2 "]["job_role"]) == ("master", "m2")
    assert got["zz"]["found_in"] is None and got[None]["found_in"] is None and len(got) == 4


def test_metadata_leaves_out_empty_values(spark):
    df = spark.createDataFrame([("e", "", "nan", 3)], "emp_id string, city string, gender string, age int")
    assert df.select(ro.metadata(df).alias("m")).first()["m"] == {"emp_id": "e", "age": "3"}


def test_roster_without_context_columns(spark):
    df = spark.sql("select 'x' job_role, 1d score, 0.1d probability, 'Low' band, 'abc' stress_level")
    r = ro.roster_table(df).first()
    assert (r["id"], r["city"], r["state"], r["mode"], r["stress"], r["prob"]) == (None, "", "", "", None, 10.0)


def test_states(spark):
    df = spark.createDataFrame([(" PUNE ", "None"), ("Atlantis", "Goa"), (None, None)], "city string, region string")
    by_city = [r["state"] for r in bd.with_state(df, city="city").orderBy("city").collect()]
    assert by_city == [None, "Maharashtra", None]
    own = bd.with_state(df, state="region", city="city")
    assert [r["state"] for r in bd.known_state(own).collect()] == ["Goa"]


# ---------------------------------------------------------------------- policies
def features(spark, rows):
    names = [c for c, _, _ in STRAIN_WEIGHTS]
    return spark.createDataFrame([tuple(float(r.get(c, 5)) for c in names) + (r.get("role"),) for r in rows],
                                 ", ".join(f"{c} double" for c in names) + ", job_role string")


def test_a_useless_policy_shows_the_floors(spark):
    df = features(spark, [{"overtime_hours": 0, "meetings_per_day": 1, "work_hours_per_week": 30, "stress_level": s} for s in (1, 9)])
    got = {r["id"]: r for r in policy.policy_whatif(df, scoring.linear_scorer(df)).collect()}
    assert set(got) == {p["id"] for p in POLICIES}
    for r in got.values():
        assert (r["score_drop"], r["rate_drop"], r["protected_employees"]) == (0.01, 0.1, 1)
        assert r["raw_score_drop"] == r["raw_rate_drop"] == 0.0


def test_caps_move_the_score_by_hand(spark):
    df = features(spark, [{"overtime_hours": 20, "stress_level": 9, "role": "a"}, {"overtime_hours": 0, "stress_level": 1, "role": "b"}])
    raw = [0.3 * s + 0.15 * (o / 2.5) for s, o in ((9, 20), (1, 0))]
    span = raw[0] - raw[1]
    drop = (0.15 * (16 / 2.5)) / span * 10 / 2
    got = {r["id"]: r for r in policy.policy_whatif(df, scoring.linear_scorer(df), total_rows=1000).collect()}
    assert got["overtime_cap"]["raw_score_drop"] == pytest.approx(drop, abs=1e-4)
    assert got["overtime_cap"]["score_drop"] == round(drop, 2)
    assert got["overtime_cap"]["preset"] == {"sl-overtime": 4}
    assert got["standard_workweek"]["protected_employees"] == 1


def test_drivers(spark):
    df = spark.createDataFrame(
        [("calm", 1.0, 1.0, 1.0, 40.0, 0.0, 2.0), ("busy", 8.0, 4.0, 1.2, 45.0, 3.0, 2.0), (None, 1.0, 1.0, 1.0, 40.0, 0.0, 2.0)],
        "job_role string, score double, overtime_hours double, meetings_per_day double, work_hours_per_week double, deadlines_missed double, stress_level double")
    got = {r["name"]: [tuple(x) for x in r["drivers"]] for r in policy.role_drivers(df).collect()}
    # strengths: overtime 3/3, hours 5/5, deadlines 3/1: deadlines first, then overtime by position
    assert got == {"calm": [("Balanced Profile", "Low friction")], "busy": [("Deadline Friction", "+3.0 missed"), ("Overtime Load", "+3.0h/wk")]}


def test_drivers_without_low_cohort_compare_with_everybody(spark):
    df = spark.createDataFrame([("a", 8.0, 0.0), ("b", 8.0, 10.0)], "job_role string, score double, overtime_hours double")
    got = {r["name"]: [tuple(x) for x in r["drivers"]] for r in policy.role_drivers(df).collect()}
    assert got["b"] == [("Overtime Load", "+5.0h/wk")] and got["a"] == [("Balanced Profile", "Low friction")]


def test_role_report_gives_empty_lists(spark):
    groups = spark.sql("select 'Unknown' name, 1d mean_score, 0d elevated_rate, 3L employees")
    drivers = spark.createDataFrame([("a", [("x", "y")])], "name string, drivers array<struct<name:string,delta:string>>")
    assert policy.role_report(groups, drivers).first()["drivers"] == []


def test_strain_bounds_are_the_reference_ones(spark):
    ref = features(spark, [{"stress_level": 1}, {"stress_level": 9}])
    one = features(spark, [{"stress_level": 5}, {"stress_level": 20}])
    scores = sorted(r["score"] for r in scoring.linear_scorer(ref)(one).collect())
    assert math.isclose(scores[0], 5.0) and scores[1] == 10.0
