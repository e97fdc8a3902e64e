"""Workforce tables derived from the sales tables.

The texts run unchanged on Spark and DuckDB. ``{orders}`` and so on stand for the
tables: parquet paths on Spark, view names on DuckDB. Every view covers its whole
base table.

* ``staff``: one person per order, answers on 1-5, untidy text, gaps, scores above 10
* ``roster``: the same people with answers on 0-100, as an upload would have them
* ``raw_employees``, ``raw_survey``, ``raw_ordinal``: the other raw layouts, from
  customer, part and supplier
* ``revisions``: one record per line item, so people occur several times
"""

STAFF = """
SELECT concat('EM', CAST(k AS STRING)) AS employee_id,
  k AS record_no,
  CAST(30 + qty % 41 AS DOUBLE) AS work_hours_per_week,
  CASE WHEN k % 17 = 0 THEN NULL ELSE CAST((k * 7) % 26 AS DOUBLE) END AS overtime_hours,
  CAST(n_lines AS DOUBLE) AS meetings_per_day,
  CAST(n_ret AS DOUBLE) AS deadlines_missed,
  CAST(k % 31 AS DOUBLE) AS experience_years,
  CASE seg WHEN 'AUTOMOBILE' THEN '  software engineer' WHEN 'BUILDING' THEN 'DevOps'
           WHEN 'FURNITURE' THEN 'QA engineer ' WHEN 'HOUSEHOLD' THEN 'full-stack dev' ELSE NULL END AS job_role,
  CASE substr(pr, 1, 1) WHEN '1' THEN 'remote' WHEN '2' THEN ' Hybrid ' WHEN '3' THEN 'ON-SITE'
           WHEN '4' THEN 'Office' ELSE NULL END AS work_mode,
  CAST(1 + (k * 13) % 5 AS DOUBLE) AS job_satisfaction,
  CASE WHEN k % 23 = 0 THEN NULL ELSE CAST(1 + (k * 19) % 5 AS DOUBLE) END AS manager_support,
  CAST(1 + (k * 29) % 5 AS DOUBLE) AS work_life_balance,
  4.0 + CAST((k * 11) % 13 AS DOUBLE) / 2.0 AS sleep_hours,
  CAST(k % 8 AS DOUBLE) AS physical_activity_days,
  CAST(1 + (k * 3) % 10 AS DOUBLE) AS stress_level,
  CAST((k * 5) % 9 AS DOUBLE) AS caffeine_intake,
  CASE k % 4 WHEN 0 THEN 'Startup' WHEN 1 THEN 'Mid-size' WHEN 2 THEN 'MNC' ELSE NULL END AS company_size,
  2.0 + CAST(k % 29 AS DOUBLE) / 2.0 AS screen_time_hours,
  CAST(1 + (k * 17) % 10 AS DOUBLE) AS social_support_score,
  CASE WHEN k % 43 = 0 THEN NULL ELSE
    least(CAST(12.0 AS DOUBLE), greatest(CAST(0.0 AS DOUBLE),
      CAST(6 * (1 + (k * 3) % 10) + 2 * coalesce(qty % 41, 10) + (k * 7) % 26 - 6 * ((k * 29) % 5) AS DOUBLE) / 14.0)) END
    AS strain_score,
  CASE nk % 6 WHEN 0 THEN 'Mumbai' WHEN 1 THEN '　pune ' WHEN 2 THEN 'BENGALURU' WHEN 3 THEN 'Chennai'
              WHEN 4 THEN 'Atlantis' ELSE NULL END AS city,
  CASE k % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE NULL END AS gender
FROM (
  SELECT o.o_orderkey AS k, o.o_orderpriority AS pr, c.c_mktsegment AS seg, c.c_nationkey AS nk,
         li.n_lines, li.qty, li.n_ret
  FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey
  LEFT JOIN (
    SELECT l_orderkey, count(*) AS n_lines, CAST(sum(l_quantity) AS BIGINT) AS qty,
           sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_ret
    FROM {lineitem} GROUP BY l_orderkey) li ON li.l_orderkey = o.o_orderkey) b
"""

ROSTER = """
SELECT employee_id, work_hours_per_week, overtime_hours, meetings_per_day, deadlines_missed, experience_years,
  job_role, work_mode, job_satisfaction * 20 AS job_satisfaction, manager_support * 20 AS manager_support,
  work_life_balance * 20 AS work_life_balance, sleep_hours, physical_activity_days, stress_level,
  caffeine_intake, company_size, screen_time_hours, social_support_score, city, gender
FROM {staff} s
"""

RAW_EMPLOYEES = """
SELECT concat('EX', CAST(c_custkey AS STRING)) AS emp_id,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(1 + c_custkey % 10 AS DOUBLE) END AS allocation,
  CAST(c_nationkey % 6 AS DOUBLE) AS designation,
  CASE c_custkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE NULL END AS wfh,
  CAST(c_custkey % 101 AS DOUBLE) / 10.0 AS fatigue,
  CASE WHEN c_custkey % 43 = 0 THEN NULL ELSE CAST((c_custkey * 37) % 101 AS DOUBLE) / 100.0 END AS burn_rate
FROM {customer} c
"""

RAW_SURVEY = """
SELECT CAST(p_partkey AS STRING) AS emp_id,
  CAST(30 + (p_size * 7) % 41 AS DOUBLE) AS hours,
  CAST(p_partkey % 31 AS DOUBLE) AS years,
  CASE p_size % 4 WHEN 0 THEN 'product owner' WHEN 1 THEN 'o''neil desk' WHEN 2 THEN 'DevOps' ELSE NULL END AS role,
  CASE p_partkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE 'Sometimes' END AS remote,
  CAST(1 + p_partkey % 10 AS DOUBLE) AS satisfaction,
  CAST(1 + (p_partkey * 7) % 5 AS DOUBLE) AS manager,
  CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE CAST(1 + p_size % 5 AS DOUBLE) END AS balance,
  4.0 + CAST(p_partkey % 11 AS DOUBLE) / 2.0 AS sleep,
  CAST(p_partkey % 15 AS DOUBLE) AS activity,
  CAST(1 + p_size % 10 AS DOUBLE) AS stress,
  CAST(1 + (p_partkey * 3) % 10 AS DOUBLE) AS felt,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size % 31 AS DOUBLE) END AS team
FROM {part} p
"""

RAW_ORDINAL = """
SELECT concat('TR', CAST(s_suppkey AS STRING)) AS emp_id,
  CAST(6 + s_suppkey % 7 AS DOUBLE) AS daily_hours,
  CASE s_nationkey % 4 WHEN 0 THEN 'Home' WHEN 1 THEN 'Office' WHEN 2 THEN 'In-Office' ELSE NULL END AS work_from,
  CASE s_suppkey % 5 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' WHEN 3 THEN 'Very High' ELSE 'Unsure' END AS satisfaction,
  CASE s_nationkey % 5 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' WHEN 3 THEN 'Very High' ELSE NULL END AS manager,
  CASE s_suppkey % 5 WHEN 0 THEN 'Poor' WHEN 1 THEN 'Fair' WHEN 2 THEN 'Good' WHEN 3 THEN 'Excellent' ELSE 'None' END AS balance,
  CASE s_suppkey % 4 WHEN 0 THEN 'Poor' WHEN 1 THEN 'Fair' WHEN 2 THEN 'Good' ELSE 'Excellent' END AS sleeping,
  CASE s_nationkey % 3 WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' ELSE NULL END AS exercise,
  CAST(1 + s_suppkey % 10 AS DOUBLE) AS stress
FROM {supplier} s
"""

# Weekly records: hours drift by line number; the text columns of the person repeat.
REVISIONS = """
SELECT 'weekly' AS source_dataset, s.employee_id, s.work_hours_per_week + l.l_linenumber AS work_hours_per_week,
  s.overtime_hours, s.meetings_per_day, s.deadlines_missed, s.experience_years, s.job_role, s.work_mode,
  s.job_satisfaction * 20 AS job_satisfaction, s.manager_support * 20 AS manager_support,
  s.work_life_balance * 20 AS work_life_balance, s.sleep_hours, s.physical_activity_days, s.stress_level,
  CAST(NULL AS DOUBLE) AS mental_fatigue_score, s.strain_score, s.caffeine_intake, s.company_size,
  s.screen_time_hours, s.social_support_score,
  l.l_linenumber AS revision, l.l_extendedprice AS stamp, l.l_partkey AS stamp_part
FROM {lineitem} l JOIN {staff} s ON s.record_no = l.l_orderkey
"""

BASE = ("orders", "customer", "lineitem", "part", "supplier")
VIEWS = {
    "staff": STAFF,
    "roster": ROSTER,
    "raw_employees": RAW_EMPLOYEES,
    "raw_survey": RAW_SURVEY,
    "raw_ordinal": RAW_ORDINAL,
    "revisions": REVISIONS,
}


def spark_view(spark, sf_dir: str, name: str, staff_path: str | None = None):
    """The view as a DataFrame over the parquet files below ``sf_dir``.

    ``staff_path`` is a stored copy of ``staff`` to build on.
    """
    tables = {t: f"parquet.`{sf_dir.rstrip('/')}/{t}.parquet`" for t in BASE}
    if "{staff}" in VIEWS[name]:
        tables["staff"] = f"parquet.`{staff_path}`" if staff_path else "(" + STAFF.format(**tables) + ")"
    return spark.sql(VIEWS[name].format(**tables))


def duckdb_views() -> str:
    """The views as common table expressions."""
    names = {t: t for t in BASE} | {"staff": "staff"}
    return ",\n".join(f"{n} AS ({text.format(**names)})" for n, text in VIEWS.items())
