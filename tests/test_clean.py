from pyspark.sql import functions as F

from strainwise.operators import align as al, clean, explore, validate
from strainwise.schema import MODEL_CATEGORICAL, MODEL_NUMERIC


def people(spark, rows):
    return spark.createDataFrame(rows, "employee_id string, source_dataset string, job_role string, "
                                       "work_hours_per_week double, sleep_hours double, rev int")


def test_imputation_falls_back_from_role_to_all_to_zero(spark):
    df = people(spark, [("1", "s", "a", None, None, 1), ("2", "s", "a", None, None, 1),
                        ("3", "s", "b", 1.0, None, 1), ("4", "s", "b", 3.0, None, 1), ("5", "s", None, None, None, 1)])
    for part_rows in (100_000, 1):
        out = {r["employee_id"]: r for r in clean.impute_missing(df, part_rows=part_rows).collect()}
        assert [out[i]["work_hours_per_week"] for i in "12345"] == [2.0, 2.0, 1.0, 3.0, 2.0]
        assert all(r["sleep_hours"] == 0.0 for r in out.values())
        assert [out[i]["work_hours_per_week_is_missing"] for i in "12345"] == [1, 1, 0, 0, 1]


def test_wide_role_table_is_joined_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(clean, "small_side", lambda df, rows: df)
    df = people(spark, [("1", "s", "a", None, 1.0, 1), ("2", "s", "a", 4.0, 1.0, 1)])
    assert {r["work_hours_per_week"] for r in clean.impute_missing(df).collect()} == {4.0}


def test_keep_first_treats_null_keys_as_equal(spark):
    df = people(spark, [(None, "s", "a", 1.0, 1.0, 2), (None, "s", "a", 9.0, 1.0, 1), ("x", None, "a", 5.0, 1.0, 1),
                        ("x", None, "a", 6.0, 1.0, 2), ("x", "s", "a", 7.0, 1.0, 1)])
    out = clean.keep_first(df, order_by=["rev"])
    assert sorted(r["work_hours_per_week"] for r in out.collect()) == [5.0, 7.0, 9.0]
    assert "WindowGroupLimit" in out._jdf.queryExecution().toString()


def test_keep_first_without_an_order_does_not_depend_on_partitions(spark):
    df = people(spark, [("x", "s", "a", float(i), 1.0, 1) for i in range(50)])
    picks = {clean.keep_first(df.repartition(n)).first()["work_hours_per_week"] for n in (1, 3, 8)}
    assert len(picks) == 1


def test_cleaning_is_idempotent(spark):
    df = spark.createDataFrame([("1", "s", " qa engineer", "HOME", None, None, 12.0), ("2", "s", None, None, "MNC", 3.0, None)],
                               "employee_id string, source_dataset string, job_role string, work_mode string, "
                               "company_size string, sleep_hours double, strain_score double")
    once = clean.preprocess(df)
    twice = clean.preprocess(once.drop("sleep_hours_is_missing"))
    cols = df.columns
    assert once.select(cols).exceptAll(twice.select(cols)).isEmpty()
    assert once.where(F.col("sleep_hours").isNull()).isEmpty()
    assert {r["strain_score"] for r in once.collect()} == {10.0, None}


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([(x,) for x in ("b", "a", "a", "b", None)], "t string")
    assert al.modes(df, ["t"]).first()["t"] == "a"
    assert al.modes(df.where("t is null"), ["t"]).first()["t"] == "Unknown"


def test_align_fills_coerces_and_adds(spark):
    defaults = {c: 1.5 for c in MODEL_NUMERIC} | {c: "d" for c in MODEL_CATEGORICAL}
    roster = spark.createDataFrame([("7", "8h", None, "x"), (None, " 9 ", "r", "y")],
                                   "sleep_hours string, stress_level string, job_role string, badge string")
    a, b = al.align(roster, defaults, keep=["badge"]).orderBy("badge").collect()
    assert (a["sleep_hours"], a["stress_level"], a["job_role"], a["work_mode"]) == (7.0, 1.5, "d", "d")
    assert (b["sleep_hours"], b["stress_level"], b["job_role"], b["caffeine_intake"]) == (1.5, 9.0, "r", 1.5)


def test_violations(spark):
    good = spark.createDataFrame([("x", 1.0, 2.0, 3.0), ("y", 1.0, 2.0, 3.0)],
                                 "strain_level string, strain_score double, stress_level double, work_hours_per_week double")
    assert validate.require_valid(good) is good
    bad = good.unionAll(good).unionAll(spark.sql("select 'z', 11d, 1d, 1d union all select 'w', null, 1d, 1d"))
    found = {r["check"]: r["violations"] for r in validate.violations(bad).collect()}
    assert found == {"required_columns": 0, "empty": 0, "missing_target": 1, "target_out_of_range": 1, "duplicate_rows": 2}
    for frame in (bad, good.where("false"), good.drop("strain_score")):
        try:
            validate.require_valid(frame)
        except ValueError:
            continue
        raise AssertionError("accepted")


def test_duplicates_are_exact(spark, monkeypatch):
    df = spark.sql("select * from values (1, 0.0d, null), (1, -0.0d, null), (1, 0.0d, 'a'), (2, 1d, 'a'), (2, 1d, 'a'), (2, 1d, 'a') t(a, b, c)")
    assert validate.count_duplicates(df) == 3
    monkeypatch.setattr(validate, "small_side", lambda d, n: d)
    assert validate.count_duplicates(df.repartition(5)) == 3
    assert validate.count_duplicates(df.distinct()) == 0


def test_model_columns():
    cols = ["employee_id", "age", "gender", "strain_level", "strain_score", "sleep_hours", "stress_level",
            "workload_index", "sleep_hours_is_missing", "anxiety_score"]
    assert validate.model_columns(cols) == ["employee_id", "sleep_hours", "sleep_hours_is_missing", "stress_level", "workload_index"]
    assert validate.model_columns(cols, pipeline=True) == ["sleep_hours"]


def test_correlation_is_pairwise(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.0, 1.0), (3.0, 6.0, 0.0), (4.0, None, 5.0)], "a double, b double, c double")
    got = {(r["left_metric"], r["right_metric"]): r["corr"] for r in explore.correlation(df, ("a", "b", "c")).collect()}
    assert got[("a", "b")] == 1.0 and got[("b", "c")] == -1.0 and len(got) == 3


def test_duplicates_of_a_larger_table_have_more_tasks(spark, monkeypatch):
    rows = [(i, None if i % 3 == 0 else f"t{i % 50}", float("nan") if i % 5 == 0 else 0.5) for i in range(200)]
    rows += rows[:60] + rows[:10] * 4 + [(7, "other", 0.0), (7, "other", -0.0)] + [(None, None, None)] * 30
    df = spark.createDataFrame(rows, "a long, `b.c` string, x double").repartition(7)
    assert validate.count_duplicates(df) == 60 + 40 + 1 + 29
    parts, kept = [], validate.materialize
    monkeypatch.setattr(validate, "materialize", lambda d: parts.append(d.rdd.getNumPartitions()) or kept(d))
    monkeypatch.setattr(validate, "TASK_ROWS", 10)
    for most in (validate.MAX_BROADCAST_ROWS, 5):  # with many repeated hashes all rows are compared
        monkeypatch.setattr(validate, "MAX_BROADCAST_ROWS", most)
        assert validate.count_duplicates(df) == 60 + 40 + 1 + 29
    assert parts == [34, 34] and validate.count_duplicates(df.where("a < 0")) == 0
