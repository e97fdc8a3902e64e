"""Four raw HR layouts mapped onto the canonical table, and their union."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import nan_to_null
from ..functions.text import recode
from ..plans.bounds import materialize, small_side
from ..schema import CANONICAL, CANONICAL_TYPE, SOURCE_LABELS, SURVEY_TARGET, TARGET
from .headers import neutral_headers

# The ordinal scales of the answer words.
REMOTE_ANSWER = {"Yes": "Remote", "No": "Onsite"}
LEVELS = {"Low": 25.0, "Medium": 50.0, "High": 75.0, "Very High": 100.0}
GRADES = {"Poor": 25.0, "Fair": 50.0, "Good": 75.0, "Excellent": 100.0}
SLEEP = {"Poor": 5.0, "Fair": 7.0, "Good": 8.0}
EXERCISE = {"No": 0.0, "Yes": 3.0}


def _canonical(df: DataFrame, source: str, known: dict) -> DataFrame:
    """Project to the 21 columns; whatever a layout does not know is NULL."""
    known = {"source_dataset": F.lit(SOURCE_LABELS[source]), **known}
    return nan_to_null(df).select(
        [(known[f.name] if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name)
         for f in CANONICAL_TYPE]
    )


def row_numbers(df: DataFrame, name: str = "row_no") -> DataFrame:
    """0-based consecutive row numbers of a file scan, without moving rows.

    The scan is stored once with its local positions, so that counting and numbering
    see the same split. Rows are counted per scan task, and each task's offset is added
    to the local position. Numbers follow the file when there is one file.
    """
    tasks = df.rdd.getNumPartitions()
    local = materialize(df.withColumn("_id", F.monotonically_increasing_id()))
    task, position = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counted = local.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counted.select("_task", F.expr("sum(_n) over (order by _task) - _n").alias("_from"))
    # one row per scan task
    joined = local.withColumn("_task", task).join(small_side(offsets, tasks), "_task")
    return joined.withColumn(name, F.col("_from") + position).drop("_id", "_task", "_from")


def from_tech(df: DataFrame, row_key: str | None = None) -> DataFrame:
    """Layout "tech": names match; three 1-5 answers go to 0-100. Ids are ``tech_<row>``."""
    df = neutral_headers(df)
    if row_key is None:
        df, row_key = row_numbers(df), "row_no"
    same = [c for c in CANONICAL if c not in ("source_dataset", "employee_id", "mental_fatigue_score")]
    known: dict[str, Column] = {c: F.col(c) for c in same}
    for c in ("job_satisfaction", "manager_support", "work_life_balance"):
        known[c] = F.col(c) * 20.0
    known["employee_id"] = F.concat(F.lit("tech_"), F.col(row_key).cast("string"))
    return _canonical(df, "tech", known)


def from_employees(df: DataFrame) -> DataFrame:
    """Layout "employees": allocation, designation and burn rate as proxies."""
    return _canonical(df, "employees", {
        "employee_id": F.col("Employee ID"),
        "work_hours_per_week": F.col("Resource Allocation") * 8.0,
        "experience_years": F.col("Designation") * 2.0,
        "job_role": F.lit("Unknown"),
        "company_size": F.lit("Unknown"),
        "work_mode": recode("WFH Setup Available", REMOTE_ANSWER),
        "mental_fatigue_score": F.col("Mental Fatigue Score") * 10.0,
        TARGET: F.col("Burn Rate") * 10.0,
    })


def from_survey(df: DataFrame) -> DataFrame:
    """Layout "survey": mixed 1-10 and 1-5 answers; size from the team (NULL counts as Medium)."""
    return _canonical(df, "survey", {
        "employee_id": F.col("EmployeeID"),
        "work_hours_per_week": F.col("WorkHoursPerWeek"),
        "experience_years": F.col("YearsAtCompany"),
        "job_role": F.col("JobRole"),
        "work_mode": recode("RemoteWork", REMOTE_ANSWER),
        "job_satisfaction": F.col("JobSatisfaction") * 10.0,
        "manager_support": F.col("ManagerSupportScore") * 20.0,
        "work_life_balance": F.col("WorkLifeBalanceScore") * 20.0,
        "sleep_hours": F.col("SleepHours"),
        "physical_activity_days": F.col("PhysicalActivityHrs") / 2.0,
        "stress_level": F.col("StressLevel"),
        TARGET: F.col(SURVEY_TARGET),
        "company_size": F.when(F.col("TeamSize") > 15, "Large").otherwise("Medium"),
    })


def from_ordinal(df: DataFrame) -> DataFrame:
    """Layout "ordinal": answer words on fixed scales, no recorded score."""
    return _canonical(df, "ordinal", {
        "employee_id": F.col("Employee_Id"),
        "work_hours_per_week": F.col("Avg_Working_Hours_Per_Day") * 5.0,
        "job_role": F.lit("Unknown"),
        "company_size": F.lit("Unknown"),
        "work_mode": F.col("Work_From"),
        "job_satisfaction": recode("Job_Satisfaction", LEVELS),
        "manager_support": recode("Manager_Support", LEVELS),
        "work_life_balance": recode("Work_Life_Balance", GRADES),
        "sleep_hours": recode("Sleeping_Habit", SLEEP),
        "physical_activity_days": recode("Exercise_Habit", EXERCISE),
        "stress_level": F.col("Stress_Level"),
    })


def unify(frames) -> DataFrame:
    """Union of the mapped sources that exist, in canonical column order."""
    present = [f for f in frames if f is not None]
    if not present:
        raise ValueError("no raw source was found")
    return reduce(DataFrame.unionByName, present).select(*CANONICAL)
