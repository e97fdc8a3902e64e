"""DuckDB SQL per query key, written independently of the Spark operators."""

from ..schema import (
    ADVICE, BANDS, CANONICAL, CITY_STATES, CORRELATED, DRIVERS, FIND_IDS, FIVE_BANDS, HOURS_BANDS, KMEANS_STARTS, MODEL_CATEGORICAL,
    MODEL_FEATURES, MODEL_NUMERIC, POLICIES, REQUIRED_UPLOAD, SOURCE_LABELS, STRAIN_WEIGHTS, STRINGS, TRACKED,
)
from .views import duckdb_views


def lit(text) -> str:
    return "'" + str(text).replace("'", "''") + "'"


def num(x) -> str:
    return f"{float(x)!r}::DOUBLE"


# the white space of Unicode, written out
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(x) -> str:
    return f"regexp_replace({x}, '^[{SPACES}]+|[{SPACES}]+$', '', 'g')"


def title(x) -> str:
    return (f"array_to_string(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN i = 1 OR NOT "
            f"regexp_matches(({x})[i - 1], '[\\p{{L}}]') THEN upper(({x})[i]) ELSE lower(({x})[i]) END), '')")


def role(x) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'Unknown' ELSE {title(strip(x))} END"


def mode_of(x) -> str:
    s = strip(x)
    cap = f"upper(substr({s}, 1, 1)) || lower(substr({s}, 2))"
    return (f"CASE WHEN {x} IS NULL THEN 'Unknown' WHEN {cap} = 'On-site' THEN 'Onsite' WHEN {cap} = 'Home' THEN 'Remote' "
            f"WHEN {cap} = 'Office' THEN 'Onsite' ELSE {cap} END")


def recode(x, pairs) -> str:
    return "CASE " + x + " " + " ".join(f"WHEN {lit(a)} THEN {b}" for a, b in pairs) + " ELSE NULL END"


def band(x, t="4.5") -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} >= {t} THEN 'Elevated' WHEN {x} >= 2.5 THEN 'Moderate' ELSE 'Low' END"


def clipped(x) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} < 0 THEN 0.0::DOUBLE WHEN {x} > 10 THEN 10.0::DOUBLE ELSE {x} END"


def strain(value=lambda c: c, scale=100.0) -> str:
    scaled = ("job_satisfaction", "manager_support", "work_life_balance")
    terms = [f"{num(w)} * ({value(c)} / {num(s * (scale / 10 if c in scaled else 1))})" for c, w, s in STRAIN_WEIGHTS]
    return " + ".join(f"({t})" for t in terms)


def workload() -> str:
    return ("100.0::DOUBLE * (0.4::DOUBLE * (work_hours_per_week / 40.0::DOUBLE) + 0.3::DOUBLE * (overtime_hours / 10.0::DOUBLE)"
            " + 0.2::DOUBLE * (meetings_per_day / 5.0::DOUBLE) + 0.1::DOUBLE * (deadlines_missed / 3.0::DOUBLE))")


def wellness(scale=100) -> str:
    return (f"100.0::DOUBLE * (0.3::DOUBLE * CASE WHEN sleep_hours IS NULL THEN NULL WHEN sleep_hours / 8.0 > 1.2 THEN 1.2::DOUBLE "
            f"WHEN sleep_hours < 0 THEN 0.0::DOUBLE ELSE sleep_hours / 8.0::DOUBLE END + 0.2::DOUBLE * (physical_activity_days / 7.0::DOUBLE)"
            f" + 0.3::DOUBLE * (work_life_balance / {num(scale)}) + 0.2::DOUBLE * (job_satisfaction / {num(scale)}))")


def hash_key(x, seed=42) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || {x}), 1, 13) AS BIGINT)"


SPAN = 16 ** 13
RATE = "round(100.0 * count(*) FILTER (WHERE {} >= 4.5) / count(*), 1)"


def _canonical(source, **known) -> str:
    parts = []
    for c in CANONICAL:
        kind = "VARCHAR" if c in STRINGS else "DOUBLE"
        value = lit(source) if c == "source_dataset" else known.get(c, "NULL")
        parts.append(f"CAST({value} AS {kind}) AS {c}")
    return "SELECT " + ", ".join(parts)


def _sources() -> dict:
    scaled = ("job_satisfaction", "manager_support", "work_life_balance")
    tech = {c: (f"{c} * 20" if c in scaled else c) for c in CANONICAL
            if c not in ("source_dataset", "employee_id", "mental_fatigue_score")}
    answers = [("Yes", "'Remote'"), ("No", "'Onsite'")]
    levels = [("Low", 25), ("Medium", 50), ("High", 75), ("Very High", 100)]
    grades = [("Poor", 25), ("Fair", 50), ("Good", 75), ("Excellent", 100)]
    return {
        "tech": _canonical(SOURCE_LABELS["tech"], employee_id="'tech_' || record_no", **tech) + " FROM staff",
        "employees": _canonical(
            SOURCE_LABELS["employees"], employee_id="emp_id", work_hours_per_week="allocation * 8",
            experience_years="designation * 2", job_role="'Unknown'", company_size="'Unknown'",
            work_mode=recode("wfh", answers), mental_fatigue_score="fatigue * 10", strain_score="burn_rate * 10",
        ) + " FROM raw_employees",
        "survey": _canonical(
            SOURCE_LABELS["survey"], employee_id="emp_id", work_hours_per_week="hours", experience_years="years",
            job_role="role", work_mode=recode("remote", answers), job_satisfaction="satisfaction * 10",
            manager_support="manager * 20", work_life_balance="balance * 20", sleep_hours="sleep",
            physical_activity_days="activity / 2", stress_level="stress", strain_score="felt",
            company_size="CASE WHEN team > 15 THEN 'Large' ELSE 'Medium' END") + " FROM raw_survey",
        "ordinal": _canonical(
            SOURCE_LABELS["ordinal"], employee_id="emp_id", work_hours_per_week="daily_hours * 5", job_role="'Unknown'",
            company_size="'Unknown'", work_mode="work_from", job_satisfaction=recode("satisfaction", levels),
            manager_support=recode("manager", levels), work_life_balance=recode("balance", grades),
            sleep_hours=recode("sleeping", [("Poor", 5), ("Fair", 7), ("Good", 8)]),
            physical_activity_days=recode("exercise", [("No", 0), ("Yes", 3)]), stress_level="stress") + " FROM raw_ordinal",
    }


def _imputed(table: str, extra="") -> str:
    """Role median, else overall median, else 0; flags from before the fill."""
    fills = ", ".join(f"coalesce(t.{c}, r.{c}, a.{c}, 0) AS {c}" for c in TRACKED)
    flags = ", ".join(f"CAST(t.{c} IS NULL AS INTEGER) AS {c}_is_missing" for c in TRACKED)
    medians = ", ".join(f"median({c}) AS {c}" for c in TRACKED)
    return (f"SELECT t.* REPLACE ({fills}), {flags}{extra} FROM {table} t "
            f"JOIN (SELECT job_role, {medians} FROM {table} GROUP BY job_role) r ON r.job_role = t.job_role "
            f"CROSS JOIN (SELECT {medians} FROM {table}) a")


def _cleaned(table: str) -> str:
    return (f"SELECT * REPLACE ({role('job_role')} AS job_role, {mode_of('work_mode')} AS work_mode, "
            f"coalesce(company_size, 'Medium') AS company_size) FROM {table}")


def _frequent(table: str, c: str) -> str:
    return f"(SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


def _base() -> str:
    """Shared tables: canonical, master, defaults, filled and scored roster, judged rows."""
    s = _sources()
    ctes = [duckdb_views()] + [f"{n} AS ({q})" for n, q in s.items()]
    ctes.append("canonical AS (" + " UNION ALL ".join(f"SELECT * FROM {n}" for n in s) + ")")
    ctes.append(f"cleaned AS ({_cleaned('canonical')})")
    ctes.append(f"imputed AS ({_imputed('cleaned')})")
    # ids are unique per source in the canonical table, so nothing is dropped here
    ctes.append(
        f"master AS (SELECT *, {workload()} AS workload_index, {wellness()} AS wellness_score, manager_support AS support_index, "
        f"meetings_per_day / 3.0::DOUBLE AS meeting_load FROM (SELECT * REPLACE ({clipped('strain_score')} AS strain_score) FROM imputed))")
    ctes.append("defaults AS (SELECT " + ", ".join(f"median({c}) AS {c}" for c in MODEL_NUMERIC) + ", "
                + ", ".join(f"{_frequent('master', c)} AS {c}" for c in MODEL_CATEGORICAL) + " FROM master)")
    ctes.append(f"ends AS (SELECT min(s) AS low, max(s) AS high FROM (SELECT {strain()} AS s FROM master))")
    ctes.append("filled AS (SELECT r.employee_id, r.city, r.gender, "
                + ", ".join(f"coalesce(r.{c}, d.{c}) AS {c}" for c in MODEL_FEATURES) + " FROM roster r CROSS JOIN defaults d)")
    score = f"({strain()} - low) / (high - low) * 10.0"
    ctes.append(f"filled_scored AS (SELECT *, {clipped('s0')} AS score FROM (SELECT f.*, {score} AS s0 FROM filled f CROSS JOIN ends))")
    ctes.append(f"scored AS (SELECT r.*, f.score, f.score / 10.0 AS probability, {band('f.score')} AS band "
                "FROM roster r JOIN filled_scored f USING (employee_id))")
    of_defaults = strain(lambda c: f"coalesce(m.{c}, d.{c})")
    ctes.append(f"judged AS (SELECT source_dataset, employee_id, strain_score AS y, round(({of_defaults} - low) / (high - low) * 10.0, 4) AS p, "
                "CAST(strain_score >= 4.5 AS INTEGER) AS label FROM master m CROSS JOIN defaults d CROSS JOIN ends WHERE strain_score IS NOT NULL)")
    ctes.append("points AS (SELECT p, sum(label) AS pos, sum(1 - label) AS neg, sum(sum(label)) OVER (ORDER BY p DESC) AS tp, "
                "sum(sum(1 - label)) OVER (ORDER BY p DESC) AS fp, sum(sum(label)) OVER () AS np, sum(sum(1 - label)) OVER () AS nn, "
                "lead(sum(label)) OVER (ORDER BY p DESC) AS next_pos, lead(sum(1 - label)) OVER (ORDER BY p DESC) AS next_neg "
                "FROM judged GROUP BY p)")
    ctes.append("cells AS (SELECT CAST(count(*) FILTER (WHERE label = 0 AND p < 5) AS DOUBLE) AS tn, CAST(count(*) FILTER (WHERE label = 0 AND p >= 5) AS DOUBLE) AS fp, "
                "CAST(count(*) FILTER (WHERE label = 1 AND p < 5) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE label = 1 AND p >= 5) AS DOUBLE) AS tp FROM "
                "(SELECT label, round(p / 10, 5) * 10 AS p FROM judged))")
    states = ", ".join(f"({lit(a)}, {lit(b)})" for a, b in CITY_STATES.items())
    ctes.append(f"states AS (SELECT * FROM (VALUES {states}) v(city_key, state))")
    ctes.append(f"located AS (SELECT s.*, t.state FROM scored s LEFT JOIN states t ON t.city_key = lower({strip('s.city')}))")
    ctes.append("roster_rows AS (SELECT employee_id AS id, coalesce(job_role, '') AS role, coalesce(work_mode, '') AS mode, coalesce(city, '') AS city, "
                "coalesce(state, '') AS state, coalesce(gender, '') AS gender, round(work_hours_per_week, 1) AS hours, round(stress_level, 1) AS stress, "
                "round(overtime_hours, 1) AS overtime, round(experience_years, 1) AS experience, round(score, 2) AS score, "
                "round(probability * 100, 1) AS prob, band FROM located)")
    ctes.append(f"drivers AS ({_drivers()})")
    ctes.append("profiles AS (SELECT s_suppkey AS profile, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE CAST(35 + s_suppkey % 30 AS VARCHAR) END AS work_hours_per_week, "
                "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(s_suppkey % 15 AS VARCHAR) END AS overtime_hours, "
                "CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE CAST(1 + s_suppkey % 10 AS VARCHAR) END AS stress_level, "
                "CASE WHEN s_suppkey % 2 = 0 THEN 'Software Engineer' ELSE '' END AS job_role FROM supplier)")
    given = {c: f"TRY_CAST(nullif(s.{c}, '') AS DOUBLE)" for c in ("work_hours_per_week", "overtime_hours", "stress_level")}
    given["job_role"] = "nullif(s.job_role, '')"
    ctes.append("scenario_rows AS (SELECT s.profile, " + ", ".join(
        f"coalesce({given[c]}, d.{c}) AS {c}" if c in given else f"d.{c}" for c in MODEL_FEATURES) + " FROM profiles s CROSS JOIN defaults d)")
    ctes.append("asked AS (SELECT DISTINCT (CASE c_custkey % 4 WHEN 0 THEN ' em' WHEN 2 THEN 'ALT' ELSE 'Ex' END) || c_custkey || ' ' AS id FROM customer)")
    second = "CASE WHEN CAST(substr(employee_id, 3) AS BIGINT) % 3 = 0 THEN NULL ELSE chr(160) || 'alt' || substr(employee_id, 3) END"
    parts = [f"SELECT 'roster' AS found_in, {i} AS place, {k} AS id_text, * FROM roster" for i, k in enumerate(("employee_id", second))]
    ctes.append(f"known AS (SELECT * EXCLUDE (id_text), lower({strip('id_text')}) AS k FROM (" + " UNION ALL BY NAME ".join(parts)
                + " UNION ALL BY NAME SELECT 'master' AS found_in, 2 AS place, employee_id AS id_text, "
                + ", ".join(c for c in CANONICAL if c not in ("source_dataset", "mental_fatigue_score", "strain_score")) + " FROM master))")
    ctes.append(f"found AS (SELECT a.id, k.* EXCLUDE (k, place) FROM asked a LEFT JOIN (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY k ORDER BY place) = 1) k "
                f"ON k.k = lower({strip('a.id')}))")
    return "WITH " + ",\n".join(ctes) + "\n"


def _drivers() -> str:
    """name, place, driver, delta per role"""
    means = ", ".join(f"avg({m}) AS {m}" for m, *_ in DRIVERS)
    low = ", ".join(f"coalesce(avg({m}) FILTER (WHERE score < 2.5), avg({m})) AS {m}" for m, *_ in DRIVERS)
    long = " UNION ALL ".join(
        f"SELECT r.job_role AS name, {i} AS pos, {lit(label)} AS driver, r.{m} - c.{m} AS gap, (r.{m} - c.{m}) / {full} AS strength, "
        f"{lit(unit)} AS unit FROM role_means r CROSS JOIN low_means c WHERE r.{m} - c.{m} > {least}"
        for i, (m, label, least, full, unit) in enumerate(DRIVERS))
    return (f"WITH role_means AS (SELECT job_role, {means} FROM filled_scored GROUP BY job_role), "
            f"low_means AS (SELECT {low} FROM filled_scored), longer AS ({long}), "
            "best AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY strength DESC, pos) - 1 AS place FROM longer) "
            "SELECT name, CAST(place AS INTEGER) AS place, driver, '+' || printf('%.1f', round(gap, 1)) || unit AS delta FROM best WHERE place < 2 "
            "UNION ALL SELECT job_role, 0, 'Balanced Profile', 'Low friction' FROM role_means WHERE job_role NOT IN (SELECT name FROM longer)")


def _breakdown(key, table="scored", limit=None) -> str:
    return (f"SELECT coalesce({key}, 'Unknown') AS name, round(avg(score), 2) AS mean_score, {RATE.format('score')} AS elevated_rate, "
            f"count(*) AS employees FROM {table} GROUP BY 1" + (f" ORDER BY 2 DESC, 4 DESC, 1 LIMIT {limit}" if limit else ""))


def _hours_case(x) -> str:
    return "CASE " + " ".join(f"WHEN {x} > {a} AND {x} <= {b} THEN {lit(n)}" for a, b, n in HOURS_BANDS) + " ELSE NULL END"


def _histogram(table, x, low, high, bins) -> str:
    w = (high - low) / bins
    place = f"CASE WHEN {x} < {low} THEN -1 WHEN {x} > {high} THEN {bins} ELSE least({bins - 1}, CAST(floor(({x} - ({num(low)})) / {num(w)}) AS BIGINT)) END"
    return (f"SELECT CAST(b AS INTEGER) AS bin, CASE WHEN b >= 0 THEN round({num(low)} + b * {num(w)}, 6) END AS low, "
            f"CASE WHEN b < {bins} THEN round({num(low)} + (b + 1) * {num(w)}, 6) END AS high, "
            f"coalesce(n, 0) AS rows FROM range(-1, {bins + 1}) g(b) LEFT JOIN (SELECT {place} AS b, "
            f"count(*) AS n FROM {table} WHERE {x} IS NOT NULL GROUP BY 1) h USING (b)")


def _whatif() -> str:
    def run(caps):
        value = lambda c: f"least({c}, {num(caps[c])})" if c in caps else c
        s = f"({strain(value)} - low) / (high - low) * 10.0"
        return (f"SELECT count(*) AS n, avg(sc) AS mean, 100.0 * avg(CASE WHEN sc >= 4.5 THEN 1.0::DOUBLE ELSE 0.0 END) AS rate "
                f"FROM (SELECT {clipped('s0')} AS sc FROM (SELECT {s} AS s0 FROM filled CROSS JOIN ends))")

    rows = []
    for p in POLICIES:
        preset = ",".join(f"{k}={v}" for k, v in sorted(p["preset"].items()))
        texts = ", ".join(f"{lit(p[c])} AS {c}" for c in ("id", "title", "badge", "description", "action", "effort"))
        rows.append(f"SELECT {texts}, {lit(preset)} AS preset, b.mean AS m0, b.rate AS r0, v.* FROM base b, ({run(p['caps'])}) v")
    return (f", base AS ({run({})}), runs AS ({' UNION ALL '.join(rows)}) "
            "SELECT id, title, badge, description, action, effort, preset, round(greatest(0.01, m0 - mean), 2) AS score_drop, "
            "round(mean, 2) AS sim_score, round(greatest(0.1, r0 - rate), 1) AS rate_drop, round(rate, 1) AS sim_elev_rate, "
            "CAST(greatest(1, round_even(n * round(greatest(0.1, r0 - rate), 1) / 100.0, 0)) AS BIGINT) AS protected_employees, "
            "round(m0 - mean, 4) AS raw_score_drop, round(r0 - rate, 4) AS raw_rate_drop FROM runs")


def _permutation() -> str:
    names = [c for c, _, _ in STRAIN_WEIGHTS]
    filled = ", ".join(f"coalesce(m.{c}, d.{c}) AS {c}" for c in names)
    order = "OVER (ORDER BY h, row_id)"
    moved = ", ".join(f"CASE WHEN lead(row_id) {order} IS NULL THEN first_value({c}) {order} ELSE lead({c}) {order} END AS o_{c}" for c in names)

    def rmse(swap):
        value = lambda c: f"o_{c}" if c == swap else c
        s = f"({strain(value)} - low) / (high - low) * 10.0"
        return (f"SELECT sqrt(avg((strain_score - sc) * (strain_score - sc))) FROM (SELECT strain_score, {clipped('s0')} AS sc FROM "
                f"(SELECT strain_score, {s} AS s0 FROM moved CROSS JOIN ends))")

    return (f", keyed AS (SELECT *, {hash_key('row_id')} AS h FROM (SELECT m.source_dataset || ':' || m.employee_id AS row_id, m.strain_score, {filled} FROM master m CROSS JOIN defaults d WHERE m.strain_score IS NOT NULL)), "
            f"moved AS (SELECT *, {moved} FROM keyed) "
            + " UNION ALL ".join(f"SELECT {lit(c)} AS feature, round(({rmse(c)}) - ({rmse(None)}), 4) AS rmse_rise" for c in names))


def _vectors() -> str:
    """Fill, centre and scale from the train rows; shares of the categories; per split and slot."""
    numeric = [c for c in MODEL_NUMERIC if c != "stress_level"]
    parts = []
    for i, c in enumerate(numeric):
        fill = f"(SELECT median({c}) FROM lab WHERE split = 'train')"
        parts.append(f"SELECT split, CAST({i} AS INTEGER) AS slot, round(avg((v - mu) / sd), 4) + 0.0 AS mean, round(stddev_pop((v - mu) / sd), 4) AS std, "
                     f"'n_{c}' AS feature FROM (SELECT split, v, avg(v) FILTER (WHERE split = 'train') OVER () AS mu, "
                     f"stddev_pop(v) FILTER (WHERE split = 'train') OVER () AS sd FROM (SELECT split, coalesce({c}, {fill}) AS v FROM lab)) GROUP BY split")
    values = " UNION ".join(f"SELECT {k} AS k, {lit(c)} AS c, {c} AS v FROM lab WHERE split = 'train'" for k, c in enumerate(MODEL_CATEGORICAL))
    holds = "CASE k " + " ".join(f"WHEN {k} THEN CAST({c} = v AS DOUBLE)" for k, c in enumerate(MODEL_CATEGORICAL)) + " END"
    parts.append(f"SELECT split, CAST(slot AS INTEGER) AS slot, round(avg({holds}), 4) + 0.0 AS mean, round(stddev_pop({holds}), 4) AS std, "
                 "'c_' || c || '_' || v AS feature FROM lab CROSS JOIN places GROUP BY split, slot, c, v")
    return (f", lab AS (SELECT *, CASE WHEN {hash_key('employee_id')} < {int(0.2 * SPAN)} THEN 'test' ELSE 'train' END AS split FROM master WHERE strain_score IS NOT NULL), "
            f"places AS (SELECT k, c, v, {len(numeric) - 1} + row_number() OVER (ORDER BY k, v) AS slot FROM ({values})) " + " UNION ALL ".join(parts))


def _report_lines() -> str:
    p = lambda a, b: f"coalesce({a} / nullif({a} + {b}, 0), 0.0)"
    f = lambda t, a, b: f"coalesce(2 * {t} / nullif(2 * {t} + {a} + {b}, 0), 0.0)"
    zero = (p("tn", "fn"), p("tn", "fp"), f("tn", "fn", "fp"))
    one = (p("tp", "fp"), p("tp", "fn"), f("tp", "fp", "fn"))

    def line(name, values, support):
        cols = ", ".join(f"round({v}, 4) AS {n}" if v else f"NULL::DOUBLE AS {n}" for n, v in zip(("precision", "recall", "f1"), values))
        return f"SELECT {lit(name)} AS class, {cols}, CAST({support} AS BIGINT) AS support FROM cells"

    rows = "(tn + fp + fn + tp)"
    return " UNION ALL ".join([
        line("Standard Risk", zero, "tn + fp"), line("Elevated Risk", one, "tp + fn"),
        line("accuracy", (None, None, f"(tn + tp) / {rows}"), rows),
        line("macro avg", [f"({a} + {b}) / 2" for a, b in zip(zero, one)], rows),
        line("weighted avg", [f"({a} * (tn + fp) + {b} * (tp + fn)) / {rows}" for a, b in zip(zero, one)], rows)])


def _round_list(columns, digits=4) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def _first_split() -> str:
    """The best split of all labelled rows by trying every feature, cut and side of the missing rows."""
    values = " UNION ALL ".join(f"SELECT {i} AS f, {lit(c)} AS feature, {c} AS v, y FROM rows" for i, c in enumerate(MODEL_NUMERIC))
    gain = "sl * sl / (nl + 1) + (st - sl) * (st - sl) / (nt - nl + 1) - st * st / (nt + 1)"
    return (
        ", rows AS (SELECT *, strain_score - avg(strain_score) OVER () AS y FROM canonical WHERE strain_score IS NOT NULL), "
        f"long AS ({values}), whole AS (SELECT f, count(*) AS nt, sum(y) AS st, count(*) FILTER (WHERE v IS NULL) AS nm, "
        "coalesce(sum(y) FILTER (WHERE v IS NULL), 0) AS sm FROM long GROUP BY f), "
        "per AS (SELECT f, feature, v, count(*) AS n, sum(y) AS s FROM long WHERE v IS NOT NULL GROUP BY f, feature, v), "
        "cuts AS (SELECT f, feature, (v + lead(v) OVER w) / 2 AS threshold, sum(n) OVER w AS n, sum(s) OVER w AS s FROM per WINDOW w AS (PARTITION BY f ORDER BY v)), "
        "sides AS (SELECT f, feature, threshold, FALSE AS missing_left, n AS nl, s AS sl FROM cuts WHERE threshold IS NOT NULL UNION ALL "
        "SELECT f, feature, threshold, TRUE, n + nm, s + sm FROM cuts JOIN whole USING (f) WHERE threshold IS NOT NULL AND nm > 0), "
        f"tried AS (SELECT *, {gain} AS gain FROM sides JOIN whole USING (f) WHERE nl >= 20 AND nt - nl >= 20) "
        "SELECT feature, round(threshold, 6) AS threshold, missing_left, round(gain, 3) AS gain, CAST(nl AS BIGINT) AS left_rows, CAST(nt - nl AS BIGINT) AS right_rows, "
        "round(sl / (nl + 1), 4) AS left_value, round((st - sl) / (nt - nl + 1), 4) AS right_value FROM tried "
        "ORDER BY round(gain, 6) DESC, f, threshold, missing_left LIMIT 1")


def _kmeans_step() -> str:
    features = ("workload_index", "wellness_score", "strain_score")
    whole = " AND ".join(f"{c} IS NOT NULL" for c in features)
    parts = []
    for r, centres in enumerate(KMEANS_STARTS):
        d = [" + ".join(f"({c} - {num(v)}) * ({c} - {num(v)})" for c, v in zip(features, centre)) for centre in centres]
        parts.append(f"SELECT CAST({r} AS INTEGER) AS restart, CAST(list_position(d, list_min(d)) - 1 AS INTEGER) AS cluster, {', '.join(features)} "
                     f"FROM (SELECT *, [{', '.join(d)}] AS d FROM master WHERE {whole})")
    return (f"SELECT restart, cluster, count(*) AS rows, {', '.join(f'round(avg({c}), 4) AS {c}' for c in features)} "
            f"FROM ({' UNION ALL '.join(parts)}) GROUP BY restart, cluster")


def oracle_sql() -> dict:
    base = _base()
    flags = ", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}_is_missing" for c in TRACKED)
    selected = sorted(set(CANONICAL) - {"strain_score", "source_dataset", "employee_id", "mental_fatigue_score", "stress_level"})
    staff_kept = sorted(["employee_id", *[c for c in CANONICAL if c not in (
        "source_dataset", "employee_id", "mental_fatigue_score", "strain_score")]])
    described = [*MODEL_NUMERIC, "strain_score", "workload_index", "wellness_score"]
    number = r"'^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$'"
    typed = ("CASE o_orderkey % 8 WHEN 0 THEN w WHEN 1 THEN ' ' || w || chr(9) WHEN 2 THEN w || 'e2' WHEN 3 THEN w || 'd' "
             "WHEN 4 THEN '0x' || w WHEN 5 THEN w || '_000' WHEN 6 THEN 'inf' ELSE '-.' || w END")
    supplied = [c for c in MODEL_FEATURES if c not in ("screen_time_hours", "caffeine_intake")]
    coverage = [(c, "required" if c in REQUIRED_UPLOAD else "optional", c if c in supplied else None) for c in MODEL_FEATURES]
    coverage += [("city", "context", "city"), ("state", "context", None), ("gender", "context", "gender"), ("employee_id", "context", "employee_id")]
    weekly = [c for c in CANONICAL if c != "work_hours_per_week"]
    meta = ["employee_id", "gender", "city", "job_role", "work_mode", "experience_years", "company_size"]
    texts = ("employee_id", "job_role", "work_mode", "company_size", "city", "gender")
    q = {
        # sources
        "src_tech": "SELECT * FROM tech",
        "src_employees": "SELECT * FROM employees",
        "src_survey": "SELECT * FROM survey",
        "src_ordinal": "SELECT * FROM ordinal",
        "unify_sources": "SELECT * FROM canonical",
        "normalize_headers": "SELECT employee_id, work_hours_per_week, job_role, city FROM roster",
        "resolve_aliases": "SELECT employee_id, city, job_role AS location, company_size AS state, gender FROM roster",
        "column_coverage": " UNION ALL ".join(
            f"SELECT {lit(f)} AS field, {lit(k)} AS kind, {'true' if c else 'false'} AS supplied, "
            f"count({c if c else 'NULL'}) AS filled, count(*) AS rows FROM roster" for f, k, c in coverage),
        "align_with_defaults": "SELECT r.employee_id, " + ", ".join(
            f"d.{c}" if c in ("screen_time_hours", "caffeine_intake") else f"coalesce(r.{c}, d.{c}) AS {c}"
            for c in MODEL_FEATURES) + " FROM roster r CROSS JOIN defaults d",
        "validate_training": f", w AS (SELECT {', '.join(weekly)} FROM revisions) "
            "SELECT 'required_columns' AS \"check\", CAST(2 AS BIGINT) AS violations UNION ALL SELECT 'empty', CAST(count(*) = 0 AS BIGINT) FROM w "
            "UNION ALL SELECT 'missing_target', count(*) FROM w WHERE strain_score IS NULL "
            "UNION ALL SELECT 'target_out_of_range', count(*) FROM w WHERE strain_score NOT BETWEEN 0 AND 10 "
            "UNION ALL SELECT 'duplicate_rows', (SELECT count(*) FROM w) - (SELECT count(*) FROM (SELECT DISTINCT * FROM w))",
        # projections, filters, scalars
        "clean_work_mode": f"SELECT employee_id, {mode_of('work_mode')} AS work_mode FROM staff",
        "clean_job_role": f"SELECT employee_id, {role('job_role')} AS job_role FROM (SELECT employee_id, job_role FROM staff UNION ALL "
            "SELECT 'P' || p_partkey, chr(9) || p_name || '/' || p_brand || '''s ' || p_type FROM part)",
        "clean_company_size": "SELECT employee_id, coalesce(company_size, 'Medium') AS company_size FROM staff",
        "missing_flags": f"SELECT source_dataset, employee_id, {flags} FROM canonical",
        "clip_score": f"SELECT employee_id, {clipped('strain_score')} AS strain_score FROM staff",
        "select_model_features": f"SELECT {', '.join(selected)} FROM master",
        "select_deployment_features": f"SELECT {', '.join(staff_kept)} FROM staff",
        "labeled_rows": "SELECT source_dataset, employee_id, strain_score FROM canonical WHERE strain_score IS NOT NULL",
        "coerce_numeric": f"SELECT o_orderkey, typed, CASE WHEN regexp_matches(typed, {number}) THEN TRY_CAST(trim(typed, ' ' || chr(9)) AS DOUBLE) END AS value "
            f"FROM (SELECT o_orderkey, {typed} AS typed FROM (SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS w FROM orders))",
        "risk_band": f"SELECT employee_id, {band('strain_score')} AS band FROM staff",
        "risk_band5": "SELECT employee_id, CASE WHEN strain_score IS NULL THEN NULL " + " ".join(
            f"WHEN strain_score >= {f} THEN {lit(n)}" for f, n in FIVE_BANDS) + " ELSE 'LOW' END AS band FROM staff",
        "recommendations": ", tiers AS (SELECT employee_id, CASE WHEN strain_score >= 6 THEN 0 WHEN strain_score >= 4.5 THEN 1 ELSE 2 END AS tier "
            "FROM staff WHERE strain_score IS NOT NULL) SELECT employee_id, CAST(place AS INTEGER) AS place, advice FROM tiers JOIN (VALUES " + ", ".join(
                f"({i}, {j}, {lit(t)})" for i, (_, ts) in enumerate(ADVICE) for j, t in enumerate(ts)) + ") v(tier, place, advice) USING (tier)",
        "hours_band": f"SELECT hours, count(*) AS rows, {_hours_case('coalesce(hours, 40)')} AS band FROM (SELECT l_quantity * l_linenumber * 5 - 5 AS hours FROM lineitem "
            "UNION ALL SELECT work_hours_per_week FROM canonical) GROUP BY hours",
        "elevated_label": "SELECT employee_id, CAST(strain_score >= 4.5 AS INTEGER) AS elevated, CAST(strain_score / 10.0 >= 0.5 AS INTEGER) AS predicted FROM staff",
        "roster_table": "SELECT * FROM roster_rows",
        "roster_filter": "SELECT * FROM roster_rows WHERE lower(id) LIKE '%m1%' AND band = 'Moderate' AND lower(city) LIKE '%une%' AND mode = 'remote'",
        "roster_search": "SELECT * FROM roster_rows WHERE lower(id) LIKE '%em1%' AND band = 'Moderate' AND lower(city) LIKE '%une%'",
        "roster_filter_pattern": "SELECT * FROM roster_rows WHERE regexp_matches(id, 'em[0-9]*7$', 'i') AND regexp_matches(city, '^(mum|beng)', 'i')",
        "scenario_fill": f"SELECT profile, {', '.join(MODEL_FEATURES)} FROM scenario_rows",
        "employee_metadata": "SELECT * FROM (" + " UNION ALL ".join(
            f"SELECT employee_id, {lit(c)} AS field, CAST({c} AS VARCHAR) AS value FROM roster" for c in meta) + ") WHERE value IS NOT NULL AND value NOT IN ('', 'nan', 'None')",
        # features
        "workload_index": f"SELECT employee_id, round({workload()}, 4) AS workload_index FROM staff",
        "wellness_score": f"SELECT employee_id, round({wellness()}, 4) AS wellness_score, round({wellness(10)}, 4) AS wellness_score_10 FROM roster",
        "support_index": "SELECT employee_id, round(manager_support, 4) AS support_index, round(manager_support * 10, 4) AS support_index_10 FROM roster",
        "meeting_load": "SELECT employee_id, round(meetings_per_day / 3, 4) AS meeting_load FROM staff",
        "feature_table": f"SELECT employee_id, round({workload()}, 4) AS workload_index, round({wellness()}, 4) AS wellness_score, "
            "round(manager_support, 4) AS support_index, round(meetings_per_day / 3, 4) AS meeting_load FROM tech",
        "linear_strain_index": f"SELECT source_dataset, employee_id, round(({strain()} - low) / (high - low) * 10.0, 4) AS strain_index FROM master CROSS JOIN ends",
        # joins
        "city_state_lookup": "SELECT employee_id, city, state FROM located",
        "state_resolve": "SELECT employee_id, company_size AS own_state, state AS city_state FROM located WHERE gender IS NOT NULL AND company_size IS NOT NULL",
        "role_report": f"SELECT g.*, coalesce((SELECT string_agg(driver || ' ' || delta, '; ' ORDER BY place) FROM drivers d WHERE d.name = g.name), '') AS drivers FROM ({_breakdown('job_role')}) g",
        "employee_find": f"SELECT i.id, found_in, employee_id, job_role, work_hours_per_week FROM (SELECT unnest([{', '.join(lit(i) for i in FIND_IDS)}]) AS id) i "
            "LEFT JOIN (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY k ORDER BY place) = 1) f ON f.k = lower(trim(i.id))",
        "employee_lookup": "SELECT id, found_in, employee_id, job_role, work_hours_per_week FROM found",
        # aggregations
        "impute_group_median": f"SELECT source_dataset, employee_id, job_role, {_round_list(TRACKED)}, overtime_hours_is_missing FROM imputed",
        "dedup_keep_first": "SELECT source_dataset, employee_id, revision, stamp, stamp_part, work_hours_per_week FROM revisions "
            "QUALIFY row_number() OVER (PARTITION BY employee_id, source_dataset ORDER BY revision, stamp, stamp_part) = 1",
        "preprocess": f", c AS ({_cleaned('revisions')}), i AS ({_imputed('c')}) SELECT source_dataset, employee_id, job_role, work_mode, company_size, revision, "
            f"round({clipped('strain_score')}, 4) AS strain_score, {_round_list(TRACKED)}, {', '.join(c + '_is_missing' for c in TRACKED)} FROM i "
            "QUALIFY row_number() OVER (PARTITION BY employee_id, source_dataset ORDER BY revision, stamp, stamp_part) = 1",
        "breakdown_role": _breakdown("job_role"),
        "breakdown_city": _breakdown("city"),
        "breakdown_gender": _breakdown("gender"),
        "breakdown_mode": _breakdown("work_mode"),
        "breakdown_state": _breakdown("state", "(SELECT * FROM located WHERE state IS NOT NULL)"),
        "breakdown_hours": _breakdown("b", f"(SELECT *, {_hours_case('coalesce(work_hours_per_week, 40)')} AS b FROM scored) WHERE b IS NOT NULL"),
        "breakdown_all": "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY dimension ORDER BY mean_score DESC, employees DESC, name) AS INTEGER) AS place FROM ("
            + " UNION ALL ".join(f"SELECT {lit(k)} AS dimension, * FROM ({_breakdown(k)})" for k in ("job_role", "city", "gender", "work_mode")) + "))",
        "fleet_summary": f"SELECT count(*) AS employees, round(avg(score), 2) AS mean_strain_score, {RATE.format('score')} AS elevated_review_rate, "
            "round(avg(probability) * 100, 1) AS mean_elevated_probability, count(*) FILTER (WHERE score < 2.5) AS low, "
            "count(*) FILTER (WHERE score >= 2.5 AND score < 4.5) AS moderate, count(*) FILTER (WHERE score >= 4.5) AS elevated FROM scored",
        "org_summary": f"SELECT count(*) AS employees, round(avg(strain_score), 2) AS mean_strain, {RATE.format('strain_score')} AS elevated_rate, "
            "round(avg(stress_level), 2) AS mean_stress, 4.5::DOUBLE AS threshold, count(*) FILTER (WHERE strain_score < 2.5) AS low, "
            "count(*) FILTER (WHERE strain_score >= 2.5 AND strain_score < 4.5) AS moderate, count(*) FILTER (WHERE strain_score >= 4.5) AS elevated FROM master",
        "mean_by_role": "SELECT job_role, round(avg(strain_score), 2) AS mean_score FROM master GROUP BY 1",
        "mean_by_mode": "SELECT work_mode, round(avg(strain_score), 2) AS mean_score FROM master GROUP BY 1",
        "default_features": f"SELECT {', '.join([*MODEL_NUMERIC, *MODEL_CATEGORICAL])} FROM defaults",
        "distinct_roles": "SELECT DISTINCT role FROM roster_rows",
        "distinct_modes": "SELECT DISTINCT mode FROM roster_rows",
        "quantile_threshold": f"SELECT round(quantile_cont(strain_score, 0.9), 4) AS threshold FROM master WHERE strain_score IS NOT NULL AND {hash_key('employee_id')} >= {int(0.2 * SPAN)}",
        "class_balance": "SELECT p AS positives, n AS negatives, round(p / (p + n), 4) AS positive_rate, round(n / greatest(p, 1), 4) AS pos_weight FROM "
            "(SELECT count(*) FILTER (WHERE strain_score >= 4.5) AS p, count(*) FILTER (WHERE strain_score < 4.5) AS n FROM master)",
        "elevated_by_company_size": f"SELECT company_size, {RATE.format('strain_score')} AS elevated_rate FROM master GROUP BY 1",
        "describe_numeric": " UNION ALL ".join(
            f"SELECT {lit(c)} AS metric, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, "
            f"round(quantile_cont({c}, 0.25), 4) AS q25, round(median({c}), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max FROM master"
            for c in described),
        "column_profile": " UNION ALL ".join(
            f"SELECT CAST({i} AS INTEGER) AS position, {lit(c)} AS column_name, {lit('string' if c in STRINGS else 'double')} AS type, count({c}) AS filled, count(*) AS rows FROM canonical"
            for i, c in enumerate(CANONICAL)),
        "score_histogram": _histogram("master", "strain_score", 0.0, 10.0, 20),
        "boxplot_by_mode": ", b AS (SELECT work_mode, quantile_cont(strain_score, 0.25) AS a1, median(strain_score) AS a2, quantile_cont(strain_score, 0.75) AS a3 FROM master WHERE strain_score IS NOT NULL GROUP BY 1) "
            "SELECT work_mode, count(*) AS rows, round(any_value(a1), 4) AS q1, round(any_value(a2), 4) AS median, round(any_value(a3), 4) AS q3, "
            "round(min(strain_score) FILTER (WHERE strain_score >= a1 - 1.5 * (a3 - a1)), 4) AS whisker_low, round(max(strain_score) FILTER (WHERE strain_score <= a3 + 1.5 * (a3 - a1)), 4) AS whisker_high, "
            "count(*) FILTER (WHERE strain_score < a1 - 1.5 * (a3 - a1) OR strain_score > a3 + 1.5 * (a3 - a1)) AS outliers FROM master JOIN b USING (work_mode) WHERE strain_score IS NOT NULL GROUP BY 1",
        "correlation_matrix": " UNION ALL ".join(
            f"SELECT {lit(a)} AS left_metric, {lit(b)} AS right_metric, round(corr({a}, {b}), 4) AS corr FROM master"
            for i, a in enumerate(CORRELATED) for b in CORRELATED[i + 1:]),
        "band_distribution": " UNION ALL ".join(f"SELECT {lit(b)} AS band, count(*) AS employees FROM scored WHERE band = {lit(b)}" for b in BANDS),
        "label_counts": "SELECT source_dataset, count(*) AS total_rows, count(strain_score) AS labeled_rows FROM canonical GROUP BY 1",
        "group_median_window": f"SELECT employee_id, job_role, sleep_hours, median(sleep_hours) OVER (PARTITION BY job_role) AS sleep_hours_job_role_median "
            f"FROM (SELECT employee_id, {role('job_role')} AS job_role, sleep_hours FROM tech)",
        "role_drivers": "SELECT name, place, driver, delta FROM drivers",
        # sorts, limits, sets
        "top_groups": _breakdown("concat_ws(' / ', job_role, work_mode, city)", limit=20),
        "breakdown_fine": _breakdown("concat_ws(' / ', job_role, work_mode, city, company_size)"),
        "roster_sort": "SELECT * FROM roster_rows ORDER BY overtime NULLS LAST, id",
        "roster_page": "SELECT * FROM roster_rows ORDER BY experience DESC NULLS LAST, id LIMIT 50 OFFSET 150",
        "roster_page_ranked": "SELECT * FROM roster_rows ORDER BY experience DESC NULLS LAST, id LIMIT 50 OFFSET 1000",
        "roster_page_after": "SELECT * FROM roster_rows WHERE hours > 25 OR hours IS NULL OR (hours = 25 AND id > 'EM5') ORDER BY hours NULLS LAST, id LIMIT 40",
        "hash_sample": f"SELECT employee_id, stress_level, strain_score FROM staff ORDER BY {hash_key('employee_id')}, employee_id LIMIT 500",
        "train_test_split": f"SELECT employee_id, CASE WHEN h < {int(0.2 * SPAN)} THEN 'test' ELSE 'train' END AS split, CAST(h % 3 AS INTEGER) AS fold FROM (SELECT employee_id, {hash_key('employee_id')} AS h FROM staff)",
        "stratified_split": f"SELECT employee_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY h) <= ceil(0.2 * count(*) OVER (PARTITION BY label)) THEN 'test' ELSE 'train' END AS split "
            f"FROM (SELECT employee_id, CAST(strain_score >= 4.5 AS INTEGER) AS label, {hash_key('employee_id')} AS h FROM staff)",
        # evaluation
        "regression_metrics": "SELECT round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(1 - avg((y - p) * (y - p)) / var_pop(y), 4) AS r2 FROM judged",
        "roc_auc": "SELECT round(sum(CAST(neg AS DOUBLE) * (tp - pos / 2.0)) / (any_value(np)::DOUBLE * any_value(nn)), 4) AS roc_auc FROM points",
        "average_precision": "SELECT round(sum(pos * (tp / (tp + fp))) / any_value(np), 4) AS average_precision FROM points",
        "f1_at_half": "SELECT round(2 * tp / (2 * tp + fp + fn), 4) AS f1, round((tp + fn) / (tp + fn + tn + fp), 4) AS positive_rate FROM cells",
        "classification_metrics": "SELECT (SELECT round(sum(CAST(neg AS DOUBLE) * (tp - pos / 2.0)) / (any_value(np)::DOUBLE * any_value(nn)), 4) FROM points) AS roc_auc, "
            "(SELECT round(sum(pos * (tp / (tp + fp))) / any_value(np), 4) FROM points) AS pr_auc, round(2 * tp / (2 * tp + fp + fn), 4) AS f1_at_0_5, round((tp + fn) / (tp + fn + tn + fp), 4) AS positive_rate FROM cells",
        "residuals": "SELECT source_dataset, employee_id, round(y, 4) AS y, p, round(y - p, 4) AS residual FROM judged",
        "residual_histogram": _histogram("(SELECT y - p AS e FROM judged)", "e", -10.0, 10.0, 40),
        "roc_curve": "SELECT p AS threshold, round(fp / nn, 6) AS fpr, round(tp / np, 6) AS tpr FROM points WHERE next_pos IS NULL OR next_pos <> pos OR next_neg <> neg UNION ALL SELECT 'infinity'::DOUBLE, 0.0, 0.0",
        "pr_curve": "SELECT p AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / np, 6) AS recall FROM points UNION ALL SELECT NULL, 1.0, 0.0",
        "confusion_matrix": " UNION ALL ".join(
            f"SELECT CAST({a} AS INTEGER) AS actual, CAST({b} AS INTEGER) AS predicted, CAST({c} AS BIGINT) AS rows FROM cells"
            for a, b, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))),
        "classification_report": _report_lines(),
        "linear_attribution": " UNION ALL ".join(
            f"SELECT {lit(c)} AS feature, round(avg(abs({num(w / s)} * ({c} - m))), 4) AS mean_abs FROM master CROSS JOIN (SELECT avg({c}) AS m FROM master)"
            for c, w, s in STRAIN_WEIGHTS),
        "permutation_importance": _permutation(),
        "boost_first_split": _first_split(),
        "sketched_quantiles": f"SELECT metric, prob, TRUE AS within FROM (SELECT unnest([{', '.join(lit(c) for c in [*TRACKED, 'strain_score'])}]) AS metric) "
            "CROSS JOIN (SELECT unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 0.9::DOUBLE]) AS prob)",
        "kmeans_step": _kmeans_step(),
        "segment_naming": "SELECT *, CASE WHEN workload_index > 55 AND strain_score > 5 THEN 'Overloaded (At Risk)' WHEN wellness_score > 65 AND strain_score < 4 THEN 'Healthy & Balanced' "
            "WHEN workload_index < 45 AND wellness_score < 50 THEN 'Disengaged' ELSE 'Moderate / Transitioning' END AS employee_segment FROM "
            "(SELECT job_role, work_mode, round(avg(workload_index), 3) AS workload_index, round(avg(wellness_score), 3) AS wellness_score, round(avg(strain_score), 3) AS strain_score FROM master GROUP BY 1, 2)",
        "numeric_statistics": " UNION ALL ".join(
            f"SELECT {lit(c)} AS feature, round(any_value(m), 4) AS fill, round(avg(coalesce({c}, m)), 4) AS mean, round(stddev_pop(coalesce({c}, m)), 4) AS std "
            f"FROM canonical CROSS JOIN (SELECT median({c}) AS m FROM canonical)" for c in MODEL_NUMERIC),
        "preprocess_vector_stats": _vectors(),
        # scenarios, what-if, report
        "scenario_scores": f"SELECT profile, round(s, 2) AS strain_score, round(s / 10.0 * 100, 1) AS elevated_risk_probability, {band('s')} AS risk_band, 4.5::DOUBLE AS threshold FROM "
            f"(SELECT profile, {clipped('s0')} AS s FROM (SELECT profile, ({strain()} - low) / (high - low) * 10.0 AS s0 FROM scenario_rows CROSS JOIN ends))",
        "score_roster": "SELECT employee_id, round(score, 4) AS score, round(probability, 4) AS probability, band FROM scored",
        "policy_whatif": _whatif(),
        "employee_report": f"SELECT id, found_in, overtime_hours, company_size, known_fields, city, round(s, 2) AS strain_score, round(s / 10.0 * 100, 1) AS elevated_risk_probability, {band('s')} AS risk_band, 4.5::DOUBLE AS threshold FROM "
            f"(SELECT *, {clipped('s0')} AS s FROM (SELECT *, ({strain()} - low) / (high - low) * 10.0 AS s0 FROM (SELECT f.id, f.found_in, f.city, "
            + " + ".join(f"CAST(f.{c} IS NOT NULL" + (f" AND f.{c} NOT IN ('', 'nan', 'None')" if c in texts else "") + " AS INTEGER)" for c in meta)
            + " AS known_fields, " + ", ".join(f"coalesce(f.{c}, d.{c}) AS {c}" for c in MODEL_FEATURES)
            + " FROM found f CROSS JOIN defaults d WHERE f.found_in IS NOT NULL) CROSS JOIN ends))",
    }
    absent = [c for c in MODEL_FEATURES if c not in (
        "work_hours_per_week", "overtime_hours", "meetings_per_day", "deadlines_missed", "experience_years",
        "job_role", "work_mode", "stress_level", "sleep_hours")]
    few = ("streamed AS (SELECT employee_id, job_role, work_mode, city, hours, " + clipped("s0") + " AS score FROM (SELECT *, (" + strain() + " - low) / (high - low) * 10.0 AS s0 FROM ("
           "SELECT r.employee_id, r.job_role, r.work_mode, r.city, r.work_hours_per_week AS hours, " + ", ".join(
               f"d.{c}" if c in absent else f"coalesce(r.{c}, d.{c}) AS {c}" for c in MODEL_NUMERIC) + " FROM roster r CROSS JOIN defaults d) CROSS JOIN ends))")
    q["stream_score_roster"] = f", {few} SELECT employee_id, round(score, 4) AS score, {band('score')} AS band FROM streamed"
    q["stream_breakdown_role"] = f", {few} " + _breakdown("job_role", "streamed")
    placed = f"(SELECT s.*, t.state FROM streamed s JOIN states t ON t.city_key = lower({strip('s.city')}))"
    banded = f"(SELECT *, {_hours_case('coalesce(hours, 40)')} AS b FROM streamed) WHERE b IS NOT NULL"
    reports = {"roles": ("job_role", "streamed"), "modes": ("work_mode", "streamed"), "cities": ("city", "streamed"),
               "states": ("state", placed), "hours": ("b", banded)}
    q["stream_reports"] = f", {few} " + " UNION ALL ".join(
        f"SELECT {lit(r)} AS report, * FROM ({_breakdown(*of)})" for r, of in reports.items())
    q["stream_fleet"] = f", {few} " + q["fleet_summary"].replace("FROM scored", "FROM (SELECT *, score / 10.0 AS probability FROM streamed)")
    return {k: _join(base, v) for k, v in q.items()}


def _join(base: str, body: str) -> str:
    body = body.strip()
    return base.rstrip() + (body if body.startswith(",") else "\n" + body)
