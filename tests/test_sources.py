import gzip
import json

import pytest

from strainwise.schema import CANONICAL, CANONICAL_TYPE, LAYOUT_FILES, RAW_TYPES, REQUIRED_UPLOAD, SURVEY_TARGET
from strainwise.sources import headers, layouts, readers, sinks


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


TECH = ("work_hours_per_week,overtime_hours,meetings_per_day,deadlines_missed,experience_years,job_role,work_mode,"
        "job_satisfaction,manager_support,work_life_balance,sleep_hours,physical_activity_days,stress_level," + RAW_TYPES["tech"].names[13] + ","
        "caffeine_intake,company_size,screen_time_hours,social_support_score,age\n")


def test_layout_files(spark, tmp_path):
    write(tmp_path / LAYOUT_FILES["tech"], TECH
          + "40,,3,1,5,dev,Remote,3,4,5,7,2,6,4.4,1,MNC,8,7,31\n50,4,3,1,5,ops,Office,1,oops,5,7,2,6,NaN,1,,8,7,44\n")
    write(tmp_path / "train.csv",
          "Employee_Id,Avg_Working_Hours_Per_Day,Work_From,Job_Satisfaction,Manager_Support,Work_Life_Balance,Sleeping_Habit,Exercise_Habit,Stress_Level\n"
          "T1,9,Home,High,Very High,Excellent,Poor,Yes,7\nT2,8,Office,Unsure,,Poor,Good,No,\n")
    df = readers.read_sources(spark, str(tmp_path))
    assert df.schema.names == list(CANONICAL) and [f.dataType for f in df.schema] == [f.dataType for f in CANONICAL_TYPE]
    rows = {r["employee_id"]: r for r in df.collect()}
    assert sorted(rows) == ["T1", "T2", "tech_0", "tech_1"]
    a, b = rows["tech_0"], rows["tech_1"]
    assert (a["job_satisfaction"], a["manager_support"], a["overtime_hours"], a["strain_score"]) == (60.0, 80.0, None, 4.4)
    assert (b["manager_support"], b["strain_score"], b["company_size"], b["mental_fatigue_score"]) == (None, None, None, None)
    t = rows["T1"]
    assert (t["work_hours_per_week"], t["job_satisfaction"], t["manager_support"], t["work_life_balance"]) == (45.0, 75.0, 100.0, 100.0)
    assert (t["sleep_hours"], t["physical_activity_days"], t["work_mode"], t["job_role"]) == (5.0, 3.0, "Home", "Unknown")
    assert rows["T2"]["job_satisfaction"] is None and rows["T2"]["stress_level"] is None


def test_no_source_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no raw source"):
        readers.read_sources(spark, str(tmp_path))
    assert readers.read_layout(spark, str(tmp_path), "tech") is None


def test_missing_column_is_an_error(spark, tmp_path):
    write(tmp_path / "train.csv", "Employee_Id,Work_From\nT1,Home\n")
    with pytest.raises(ValueError, match="columns absent"):
        readers.read_sources(spark, str(tmp_path))


def test_files_of_a_folder_are_matched_by_name(spark, tmp_path):
    write(tmp_path / "a.csv", "job_role,work_hours_per_week\nops,55\n")
    write(tmp_path / "b.csv", "work_hours_per_week,job_role,city\n60,dev,Pune\n")
    write(tmp_path / "c.csv", "job_role\nqa\n")
    write(tmp_path / "d.csv", "city,job_role\nOslo,art\n")
    out = readers.read_csv(spark, str(tmp_path))
    assert {(r["job_role"], r["work_hours_per_week"], r["city"]) for r in out.collect()} == {
        ("ops", "55", None), ("dev", "60", "Pune"), ("qa", None, None), ("art", None, "Oslo")}
    schema = "work_hours_per_week double, job_role string"
    typed = readers.read_csv(spark, str(tmp_path), spark.createDataFrame([], schema).schema)
    assert {tuple(r) for r in typed.collect()} == {(55.0, "ops"), (60.0, "dev"), (None, "qa"), (None, "art")}
    with pytest.raises(ValueError, match="columns absent"):
        readers.read_csv(spark, str(tmp_path), spark.createDataFrame([], "age double").schema)


def test_headers_of_many_files_need_few_jobs(spark, tmp_path):
    kinds = ["job_role,city", "city,job_role", '"job_role",work_mode,city']
    for i in range(500):
        values = {"job_role": f"r{i}", "city": f"c{i}", "work_mode": "home"}
        names = kinds[i % 3].replace('"', "").split(",")
        write(tmp_path / f"part {i:03}.csv", kinds[i % 3] + "\n" + ",".join(values[n] for n in names) + "\n")
    spark.sparkContext.setJobGroup("headers", "headers of many files")
    out = readers.read_csv(spark, str(tmp_path))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("headers"))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert jobs <= 10
    assert out.count() == 500 and out.where("work_mode = 'home'").count() == 166
    assert out.where("substr(job_role, 2) = substr(city, 2) and job_role like 'r%'").count() == 500


def test_first_lines_of_odd_files(spark, tmp_path):
    write(tmp_path / "a.csv", "\ufeffcity,job_role\nPune,ops\n")
    write(tmp_path / "b.csv", "\n  \ncity,job_role\r\nOslo,dev\r\n")
    write(tmp_path / "c.csv", "")
    with gzip.open(tmp_path / "d.csv.gz", "wt") as packed:
        packed.write('"job_role","city"\nqa,"Bern, CH"\n')
    write(tmp_path / "e.csv", "city,city,\nLima,x,y\n")
    found = readers.csv_headers(spark, str(tmp_path))
    assert {names: len(files) for names, files in found.items()} == {
        ("city", "job_role"): 2, (): 1, ("job_role", "city"): 1, ("city0", "city1", "_c2"): 1}
    (tmp_path / "e.csv").unlink()
    assert {tuple(r) for r in readers.read_csv(spark, str(tmp_path)).select("city", "job_role").collect()} == {
        ("Pune", "ops"), ("Oslo", "dev"), ("Bern, CH", "qa")}


def test_header_names_with_line_breaks(spark, tmp_path):
    write(tmp_path / "a.csv", '"job\nrole",city\nops,Pune\n')
    write(tmp_path / "b.csv", 'city,"job\nrole"\nOslo,dev\n')
    out = readers.read_csv(spark, str(tmp_path), multi_line=True)
    assert {(r["job\nrole"], r["city"]) for r in out.collect()} == {("ops", "Pune"), ("dev", "Oslo")}


def test_line_breaks_inside_values(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'job_role,city\n"on\ncall",Pune\n')
    assert [tuple(r) for r in readers.read_csv(spark, path, multi_line=True).collect()] == [("on\ncall", "Pune")]


def test_survey_team_size(spark):
    cols = "EmployeeID long, WorkHoursPerWeek double, YearsAtCompany double, JobRole string, RemoteWork string, JobSatisfaction double, " \
           "ManagerSupportScore double, WorkLifeBalanceScore double, SleepHours double, PhysicalActivityHrs double, StressLevel double, " \
           f"{SURVEY_TARGET} double, TeamSize double"
    raw = spark.createDataFrame([(1, 40., 2., "a", "Yes", 7., 3., 4., 7., 5., 3., 4., 16.), (2, 40., 2., "a", "Maybe", 7., 3., 4., 7., 5., 3., 4., None)], cols)
    a, b = layouts.from_survey(raw).orderBy("employee_id").collect()
    assert (a["employee_id"], a["company_size"], a["work_mode"], a["physical_activity_days"]) == ("1", "Large", "Remote", 2.5)
    assert (b["company_size"], b["work_mode"]) == ("Medium", None)


def test_row_numbers_are_dense(spark, sf):
    df = layouts.row_numbers(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey"))
    n = df.count()
    assert sorted(r["row_no"] for r in df.collect()) == list(range(n))


def test_upload_guards(spark, tmp_path):
    path = write(tmp_path / "up.csv", "a,b\n1,2\n3,4\n")
    assert readers.read_roster(spark, path, max_rows=2, max_bytes=100).count() == 2
    with pytest.raises(ValueError, match="exceeds 1 rows"):
        readers.read_roster(spark, path, max_rows=1)
    with pytest.raises(ValueError, match="exceeds 3 bytes"):
        readers.read_roster(spark, path, max_bytes=3)
    with pytest.raises(ValueError, match="Only CSV"):
        readers.read_roster(spark, str(tmp_path / "up.xlsx"))
    with pytest.raises(ValueError, match="no employee rows"):
        readers.read_roster(spark, write(tmp_path / "none.csv", "a,b\n"))


def test_header_rules(spark):
    df = spark.createDataFrame([(1, 2, 3)], "` Work Hours ` int, `Emp_ID` int, EmployeeID int")
    out = headers.normalize_headers(df)
    assert out.columns == ["work_hours", "emp_id", "employeeid"]
    assert headers.resolve_aliases(out).columns == ["work_hours", "emp_id", "employee_id"]
    with pytest.raises(ValueError, match="collide"):
        headers.normalize_headers(spark.createDataFrame([(1, 2)], "`A b` int, `a_b` int"))
    with pytest.raises(ValueError, match="lacks these columns: deadlines_missed, experience_years"):
        headers.require_fields(out)
    assert headers.alias_of(["sex", "gender"], "gender") == "gender" and headers.alias_of(["x"], "city") is None


def test_coverage_counts(spark):
    df = spark.createDataFrame([(1.0, None, "F"), (2.0, "dev", None)], "sleep_hours double, job_role string, sex string")
    got = {r["field"]: (r["kind"], r["supplied"], r["filled"], r["rows"]) for r in headers.coverage(df).collect()}
    assert got["sleep_hours"] == ("optional", True, 2, 2) and got["job_role"] == ("required", True, 1, 2)
    assert got["gender"] == ("context", True, 1, 2) and got["city"] == ("context", False, 0, 2)
    assert sum(1 for k in got.values() if k[0] == "required") == len(REQUIRED_UPLOAD)


def test_threshold_and_sinks(spark, tmp_path):
    path = write(tmp_path / "metrics.json", json.dumps({"risk_model": {"threshold": 3.7}}, indent=1))
    assert readers.read_threshold(spark, path) == 3.7
    with pytest.raises(Exception):
        readers.read_threshold(spark, write(tmp_path / "empty.json", json.dumps({"risk_model": {"x": 1}})))
    facts = spark.sql("select 10L rows, 8L labeled")
    comparison = spark.createDataFrame([("b", 1.0, 2.0, 0.5), ("a", 1.0, 1.5, 0.6)], "model string, mae double, rmse double, r2 double")
    sinks.write_json(sinks.metrics_document(facts, comparison, ["x"], 4.5, 0.9), str(tmp_path / "doc"))
    doc = spark.read.json(str(tmp_path / "doc")).first()
    assert doc["recommended_model"] == "a" and doc["risk_model"]["threshold"] == 4.5 and doc["dataset"]["labeled_rows"] == 8
    for fmt in ("csv", "parquet"):
        sinks.write_master(comparison, str(tmp_path / fmt), fmt)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == sinks.read_master(spark, str(tmp_path / "parquet")).count() == 2
