"""One callable per operator: ``(spark, sf_dir) -> DataFrame`` over whole tables.

Operators that need a score use the linear strain index, which has an exact SQL
counterpart; queries on fitted models say so in their name.
"""

from functools import partial

from pyspark.sql import DataFrame, functions as F

from ..functions import bands, indices
from ..functions.numbers import clip
from ..functions.text import as_number
from ..operators import attribution, boosting, breakdown as bd, clean, clustered, clusters, evaluate as ev, explore, models, policy
from ..operators import roster as ro, sampling, scoring, text_index, tree_shares, validate
from ..operators.align import align, default_features, fill_scenarios, fit_defaults
from ..plans.bounds import scratch_folder, write_scratch
from ..schema import FIND_IDS, KMEANS_STARTS, MODEL_NUMERIC, STRAIN_WEIGHTS, SURVEY_TARGET, TRACKED
from ..sources import headers, layouts
from ..sources.readers import path_exists
from ..streaming import roster_stream
from .views import spark_view

QUERIES = {}
_TABLES = {}


def query(name):
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


def queries() -> dict:
    return dict(QUERIES)


# ----------------------------------------------------------------- shared tables
def _fitted(spark, d, name, fit):
    """Build a shared table or statistic once per application and folder.

    A table whose files are gone is built again.
    """
    key = (spark.sparkContext.applicationId, d, name)
    known = _TABLES.get(key)
    paths = [x for x in (known if isinstance(known, tuple) else (known,)) if isinstance(x, str)]
    if known is None or not all(path_exists(spark, p) for p in paths):
        _TABLES[key] = known = fit()
    return known


def _staff_path(spark, d) -> str:
    # stands for the uploaded files: written once, in several parts
    return _fitted(spark, d, "staff", lambda: write_scratch(spark_view(spark, d, "staff").repartition("employee_id")))


def staff(spark, d) -> DataFrame:
    return spark.read.parquet(_staff_path(spark, d))


def roster(spark, d) -> DataFrame:
    return spark_view(spark, d, "roster", _staff_path(spark, d))


def revisions(spark, d) -> DataFrame:
    path = _fitted(spark, d, "revisions", lambda: write_scratch(
        spark_view(spark, d, "revisions", _staff_path(spark, d)).repartition("employee_id")))
    return spark.read.parquet(path)


def tech(spark, d) -> DataFrame:
    return layouts.from_tech(staff(spark, d), row_key="record_no")


def employees(spark, d) -> DataFrame:
    raw = spark_view(spark, d, "raw_employees").toDF(
        "Employee ID", "Resource Allocation", "Designation", "WFH Setup Available", "Mental Fatigue Score", "Burn Rate")
    return layouts.from_employees(raw)


def survey(spark, d) -> DataFrame:
    raw = spark_view(spark, d, "raw_survey").toDF(
        "EmployeeID", "WorkHoursPerWeek", "YearsAtCompany", "JobRole", "RemoteWork", "JobSatisfaction",
        "ManagerSupportScore", "WorkLifeBalanceScore", "SleepHours", "PhysicalActivityHrs", "StressLevel",
        SURVEY_TARGET, "TeamSize")
    return layouts.from_survey(raw)


def ordinal(spark, d) -> DataFrame:
    raw = spark_view(spark, d, "raw_ordinal").toDF(
        "Employee_Id", "Avg_Working_Hours_Per_Day", "Work_From", "Job_Satisfaction", "Manager_Support",
        "Work_Life_Balance", "Sleeping_Habit", "Exercise_Habit", "Stress_Level")
    return layouts.from_ordinal(raw)


def canonical(spark, d) -> DataFrame:
    return layouts.unify([tech(spark, d), employees(spark, d), survey(spark, d), ordinal(spark, d)])


def master(spark, d) -> DataFrame:
    """Cleaned, imputed, de-duplicated table of all four sources with its indices."""
    path = _fitted(spark, d, "master", lambda: write_scratch(
        indices.with_indices(clean.preprocess(canonical(spark, d)))))
    return spark.read.parquet(path)


def defaults(spark, d) -> dict:
    return _fitted(spark, d, "defaults", lambda: fit_defaults(master(spark, d)))


def scorer(spark, d):
    return _fitted(spark, d, "scorer", lambda: scoring.linear_scorer(master(spark, d)))


def filled(spark, d, keep=("employee_id", "city", "gender")) -> DataFrame:
    return align(roster(spark, d), defaults(spark, d), keep=keep)


def scored(spark, d) -> DataFrame:
    """The roster as given, plus score, probability and band."""
    return scoring.score_roster(roster(spark, d), defaults(spark, d), scorer(spark, d))


def judged(spark, d) -> DataFrame:
    """All labelled people: recorded score, label, and the strain index of their filled features as prediction."""
    people = align(validate.labeled(master(spark, d)), defaults(spark, d),
                   keep=["source_dataset", "employee_id", "strain_score"])
    df = scoring.linear_strain(people, bounds=_fitted(spark, d, "bounds", lambda: {"ends": scoring.strain_bounds(master(spark, d))})["ends"])
    p = F.round(F.col("strain_index"), 4)
    return df.select("source_dataset", "employee_id", F.col("strain_score").alias("y"), p.alias("p"),
                     bands.elevated("strain_score").alias("label"), F.round(p / 10.0, 5).alias("probability"),
                     bands.predicted_class(F.round(p / 10.0, 5)).alias("predicted"))


# ------------------------------------------------------------------------ sources
@query("src_tech")
def src_tech(spark, d):
    return tech(spark, d)


@query("src_employees")
def src_employees(spark, d):
    return employees(spark, d)


@query("src_survey")
def src_survey(spark, d):
    return survey(spark, d)


@query("src_ordinal")
def src_ordinal(spark, d):
    return ordinal(spark, d)


@query("unify_sources")
def unify_sources(spark, d):
    return canonical(spark, d)


@query("normalize_headers")
def normalize_headers(spark, d):
    untidy = roster(spark, d).select(
        F.col("employee_id").alias(" Employee ID "), F.col("work_hours_per_week").alias("Work Hours Per Week"),
        F.col("job_role").alias("JOB_ROLE"), F.col("city").alias("City"))
    return headers.normalize_headers(untidy)


@query("resolve_aliases")
def resolve_aliases(spark, d):
    r = roster(spark, d)
    other = r.select(F.col("employee_id").alias("emp_id"), F.col("city").alias("employee_location"),
                     F.col("job_role").alias("location"), F.col("company_size").alias("province"),
                     F.col("gender").alias("sex"))
    return headers.resolve_aliases(other)


@query("column_coverage")
def column_coverage(spark, d):
    r = roster(spark, d).drop("screen_time_hours", "caffeine_intake").withColumnRenamed("gender", "sex")
    return headers.coverage(r)


@query("align_with_defaults")
def align_with_defaults(spark, d):
    # the roster lacks two optional columns and sends one metric as text
    r = roster(spark, d).drop("screen_time_hours", "caffeine_intake")
    r = r.withColumn("overtime_hours", F.coalesce(F.col("overtime_hours").cast("string"), F.lit("n/a")))
    return align(r, defaults(spark, d), keep=["employee_id"])


@query("validate_training")
def validate_training(spark, d):
    weekly = revisions(spark, d).drop("revision", "stamp", "stamp_part", "work_hours_per_week")
    return validate.violations(weekly)


# --------------------------------------------------- projections, filters, scalars
@query("clean_work_mode")
def clean_work_mode(spark, d):
    return staff(spark, d).select("employee_id", clean.clean_work_mode().alias("work_mode"))


@query("clean_job_role")
def clean_job_role(spark, d):
    people = staff(spark, d).select("employee_id", "job_role")
    parts = spark.read.parquet(f"{d}/part.parquet").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("employee_id"),
        F.concat(F.lit("\t"), F.col("p_name"), F.lit("/"), F.col("p_brand"), F.lit("'s "), F.col("p_type")).alias("job_role"))
    return people.unionByName(parts).select("employee_id", clean.clean_job_role().alias("job_role"))


@query("clean_company_size")
def clean_company_size(spark, d):
    return staff(spark, d).select("employee_id", clean.clean_company_size().alias("company_size"))


@query("missing_flags")
def missing_flags(spark, d):
    flagged = clean.flag_missing(canonical(spark, d))
    return flagged.select("source_dataset", "employee_id", *[f"{c}_is_missing" for c in TRACKED])


@query("clip_score")
def clip_score(spark, d):
    return staff(spark, d).select("employee_id", clip("strain_score", 0.0, 10.0).alias("strain_score"))


@query("select_model_features")
def select_model_features(spark, d):
    return validate.select_features(master(spark, d), pipeline=True)


@query("select_deployment_features")
def select_deployment_features(spark, d):
    personal = staff(spark, d).drop("record_no", "city").withColumn("strain_level", bands.risk_band("strain_score"))
    return validate.select_features(validate.drop_engineered(indices.with_indices(personal)))


@query("labeled_rows")
def labeled_rows(spark, d):
    return validate.labeled(canonical(spark, d)).select("source_dataset", "employee_id", "strain_score")


@query("coerce_numeric")
def coerce_numeric(spark, d):
    # order totals in the many ways people type numbers
    o = spark.read.parquet(f"{d}/orders.parquet")
    whole, way = F.floor("o_totalprice").cast("string"), F.col("o_orderkey") % 8
    typed = (F.when(way == 0, whole).when(way == 1, F.concat(F.lit(" "), whole, F.lit("\t")))
             .when(way == 2, F.concat(whole, F.lit("e2"))).when(way == 3, F.concat(whole, F.lit("d")))
             .when(way == 4, F.concat(F.lit("0x"), whole)).when(way == 5, F.concat(whole, F.lit("_000")))
             .when(way == 6, F.lit("inf")).otherwise(F.concat(F.lit("-."), whole)))
    return o.select("o_orderkey", typed.alias("typed")).withColumn("value", as_number("typed"))


@query("risk_band")
def risk_band(spark, d):
    return staff(spark, d).select("employee_id", bands.risk_band("strain_score").alias("band"))


@query("risk_band5")
def risk_band5(spark, d):
    return staff(spark, d).select("employee_id", bands.risk_band5("strain_score").alias("band"))


@query("recommendations")
def recommendations(spark, d):
    lines = F.posexplode(bands.advice("strain_score")).alias("place", "advice")
    return staff(spark, d).select("employee_id", lines)


@query("hours_band")
def hours_band(spark, d):
    # canonical hours reach from 8 upwards and have gaps; line extension gives out-of-range values
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    many = li.select((F.col("l_quantity") * F.col("l_linenumber") * 5 - 5).alias("hours"))
    some = canonical(spark, d).select(F.col("work_hours_per_week").alias("hours"))
    return (many.unionByName(some).groupBy("hours").agg(F.count(F.lit(1)).alias("rows"))
            .select("hours", "rows", bands.hours_band("hours").alias("band")))


@query("elevated_label")
def elevated_label(spark, d):
    return staff(spark, d).select("employee_id", bands.elevated("strain_score").alias("elevated"),
                                  bands.predicted_class(F.col("strain_score") / 10.0).alias("predicted"))


@query("roster_table")
def roster_table(spark, d):
    return ro.roster_table(scored(spark, d))


@query("roster_filter")
def roster_filter(spark, d):
    table = ro.roster_table(scored(spark, d))
    return ro.filter_roster(table, search="m1", band="Moderate", city="une", mode="remote")


@query("roster_filter_pattern")
def roster_filter_pattern(spark, d):
    table = ro.roster_table(scored(spark, d))
    return ro.filter_roster(table, search="em[0-9]*7$", city="^(mum|beng)", band="nonsense", regex=True)


@query("roster_search")
def roster_search(spark, d):
    """Ids and cities by parts of them, from the stored index; the table is indexed once."""
    def lay_out():
        path = scratch_folder(spark)
        text_index.index_roster(ro.roster_table(scored(spark, d)), path)
        return path

    return text_index.search_roster(spark, _fitted(spark, d, "by_letters", lay_out), search="EM1", city="uNe", band="Moderate")


def _profiles(spark, d):
    """Scenario profiles: a few typed fields per supplier, the rest left to the defaults."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("profile"),
        F.when(k % 4 == 0, "").otherwise((F.lit(35) + k % 30).cast("string")).alias("work_hours_per_week"),
        F.when(k % 3 == 0, None).otherwise((k % 15).cast("string")).alias("overtime_hours"),
        F.when(k % 5 == 0, "").otherwise((1 + k % 10).cast("string")).alias("stress_level"),
        F.when(k % 2 == 0, "Software Engineer").otherwise("").alias("job_role"))


@query("scenario_fill")
def scenario_fill(spark, d):
    return fill_scenarios(_profiles(spark, d), defaults(spark, d), keep=["profile"])


@query("employee_metadata")
def employee_metadata(spark, d):
    r = roster(spark, d)
    return r.select("employee_id", F.explode(ro.metadata(r)).alias("field", "value"))


# ----------------------------------------------------------------------- features
@query("workload_index")
def workload_index(spark, d):
    return staff(spark, d).select("employee_id", F.round(indices.workload_index(), 4).alias("workload_index"))


@query("wellness_score")
def wellness_score(spark, d):
    return roster(spark, d).select("employee_id", F.round(indices.wellness_score(), 4).alias("wellness_score"),
                                   F.round(indices.wellness_score(10.0), 4).alias("wellness_score_10"))


@query("support_index")
def support_index(spark, d):
    return roster(spark, d).select("employee_id", F.round(indices.support_index(), 4).alias("support_index"),
                                   F.round(indices.support_index(10.0), 4).alias("support_index_10"))


@query("meeting_load")
def meeting_load(spark, d):
    return staff(spark, d).select("employee_id", F.round(indices.meeting_load(), 4).alias("meeting_load"))


@query("feature_table")
def feature_table(spark, d):
    f = indices.with_indices(tech(spark, d))
    return f.select("employee_id", *[F.round(c, 4).alias(c) for c in (
        "workload_index", "wellness_score", "support_index", "meeting_load")])


@query("linear_strain_index")
def linear_strain_index(spark, d):
    df = scoring.linear_strain(master(spark, d))
    return df.select("source_dataset", "employee_id", F.round("strain_index", 4).alias("strain_index"))


# -------------------------------------------------------------------------- joins
@query("city_state_lookup")
def city_state_lookup(spark, d):
    return bd.with_city_state(roster(spark, d)).select("employee_id", "city", "state")


@query("state_resolve")
def state_resolve(spark, d):
    r = roster(spark, d).withColumn("province", F.when(F.col("gender").isNull(), "None").otherwise(F.col("company_size")))
    own = bd.with_state(r, state="province", city="city", name="own_state")
    both = bd.with_state(own, city="city", name="city_state")
    return bd.known_state(both, "own_state").select("employee_id", "own_state", "city_state")


@query("role_report")
def role_report(spark, d):
    groups = bd.breakdown(scored(spark, d), "job_role")
    drivers = policy.role_drivers(scoring.score_features(filled(spark, d), scorer(spark, d)))
    told = policy.role_report(groups, drivers)
    lines = F.concat_ws("; ", F.transform("drivers", lambda x: F.concat(x["name"], F.lit(" "), x["delta"])))
    return told.select("name", "mean_score", "elevated_rate", "employees", lines.alias("drivers"))


def _found(spark, d):
    """Every customer number is asked for as an employee id, untidily."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    kind = F.col("c_custkey") % 4
    asked = c.select(F.concat(F.when(kind == 0, F.lit(" em")).when(kind == 2, F.lit("ALT")).otherwise(F.lit("Ex")),
                              F.col("c_custkey").cast("string"), F.lit(" ")).alias("id"))
    # two people in three have a second id, padded with a no-break space
    number = F.substring("employee_id", 3, 20)
    people = roster(spark, d).withColumn("emp_id", F.when(
        number.cast("bigint") % 3 != 0, F.concat(F.lit("\u00a0alt"), number)))
    return ro.lookup(asked, people, master(spark, d)).drop("emp_id")


@query("employee_lookup")
def employee_lookup(spark, d):
    return _found(spark, d).select("id", "found_in", "employee_id", "job_role", "work_hours_per_week")


@query("employee_find")
def employee_find(spark, d):
    """A few ids from the stored layout; both tables are laid out once."""
    def lay_out():
        number = F.substring("employee_id", 3, 20)
        people = roster(spark, d).withColumn("emp_id", F.when(
            number.cast("bigint") % 3 != 0, F.concat(F.lit("\u00a0alt"), number)))
        path = scratch_folder(spark)
        clustered.store_by_id({"roster": people, "master": master(spark, d)}, path)
        return path

    found = clustered.find_by_id(spark, _fitted(spark, d, "by_id", lay_out), FIND_IDS)
    return found.select("id", "found_in", "employee_id", "job_role", "work_hours_per_week")


# ------------------------------------------------------------------- aggregations
@query("impute_group_median")
def impute_group_median(spark, d):
    df = clean.impute_missing(clean.clean_categories(canonical(spark, d)))
    return df.select("source_dataset", "employee_id", "job_role", *[F.round(c, 4).alias(c) for c in TRACKED],
                     "overtime_hours_is_missing")


@query("dedup_keep_first")
def dedup_keep_first(spark, d):
    weekly = revisions(spark, d).select(
        "source_dataset", "employee_id", "revision", "stamp", "stamp_part", "work_hours_per_week")
    return clean.keep_first(weekly, order_by=["revision", "stamp", "stamp_part"])


@query("preprocess")
def preprocess(spark, d):
    df = clean.preprocess(revisions(spark, d), order_by=["revision", "stamp", "stamp_part"])
    return df.select("source_dataset", "employee_id", "job_role", "work_mode", "company_size", "revision",
                     F.round("strain_score", 4).alias("strain_score"), *[F.round(c, 4).alias(c) for c in TRACKED],
                     *[f"{c}_is_missing" for c in TRACKED])


@query("breakdown_role")
def breakdown_role(spark, d):
    return bd.breakdown(scored(spark, d), "job_role")


@query("breakdown_city")
def breakdown_city(spark, d):
    return bd.breakdown(scored(spark, d), "city")


@query("breakdown_gender")
def breakdown_gender(spark, d):
    return bd.breakdown(scored(spark, d), "gender")


@query("breakdown_mode")
def breakdown_mode(spark, d):
    return bd.breakdown(scored(spark, d), "work_mode")


@query("breakdown_state")
def breakdown_state(spark, d):
    return bd.breakdown_state(bd.with_state(scored(spark, d), city="city"))


@query("breakdown_hours")
def breakdown_hours(spark, d):
    return bd.breakdown_hours(scored(spark, d))


@query("breakdown_all")
def breakdown_all(spark, d):
    return bd.breakdown_all(scored(spark, d), ["job_role", "city", "gender", "work_mode"])


@query("fleet_summary")
def fleet_summary(spark, d):
    return bd.fleet_summary(scored(spark, d))


@query("org_summary")
def org_summary(spark, d):
    return bd.org_summary(master(spark, d))


@query("mean_by_role")
def mean_by_role(spark, d):
    return bd.mean_by(master(spark, d), "job_role")


@query("mean_by_mode")
def mean_by_mode(spark, d):
    return bd.mean_by(master(spark, d), "work_mode")


@query("default_features")
def default_features_query(spark, d):
    return default_features(master(spark, d))


@query("distinct_roles")
def distinct_roles(spark, d):
    return ro.distinct_sorted(ro.roster_table(scored(spark, d)), "role")


@query("distinct_modes")
def distinct_modes(spark, d):
    return ro.distinct_sorted(ro.roster_table(scored(spark, d)), "mode")


@query("quantile_threshold")
def quantile_threshold(spark, d):
    train = sampling.with_split(validate.labeled(master(spark, d))).where("split = 'train'")
    return explore.quantile_threshold(train).select(F.round("threshold", 4).alias("threshold"))


@query("class_balance")
def class_balance(spark, d):
    return explore.class_balance(master(spark, d))


@query("elevated_by_company_size")
def elevated_by_company_size(spark, d):
    return bd.elevated_by(master(spark, d), "company_size")


@query("describe_numeric")
def describe_numeric(spark, d):
    return explore.describe(master(spark, d), [*MODEL_NUMERIC, "strain_score", "workload_index", "wellness_score"])


@query("column_profile")
def column_profile(spark, d):
    return explore.column_profile(canonical(spark, d))


@query("score_histogram")
def score_histogram(spark, d):
    return explore.histogram(master(spark, d), "strain_score", 0.0, 10.0, 20)


@query("boxplot_by_mode")
def boxplot_by_mode(spark, d):
    return explore.boxplot(master(spark, d), "work_mode")


@query("correlation_matrix")
def correlation_matrix(spark, d):
    return explore.correlation(master(spark, d))


@query("band_distribution")
def band_distribution(spark, d):
    return bd.band_distribution(scored(spark, d))


@query("label_counts")
def label_counts(spark, d):
    return explore.label_counts(canonical(spark, d))


@query("group_median_window")
def group_median_window(spark, d):
    df = clean.median_per_role_window(clean.clean_categories(tech(spark, d)), "sleep_hours")
    return df.select("employee_id", "job_role", "sleep_hours", "sleep_hours_job_role_median")


@query("role_drivers")
def role_drivers(spark, d):
    told = policy.role_drivers(scoring.score_features(filled(spark, d), scorer(spark, d)))
    return told.select("name", F.posexplode("drivers").alias("place", "d")).select(
        "name", "place", F.col("d.name").alias("driver"), F.col("d.delta").alias("delta"))


# -------------------------------------------------------------- sorts, limits, sets
@query("top_groups")
def top_groups(spark, d):
    # groups by customer segment and role: more than the report shows
    return bd.breakdown(scored(spark, d), F.concat_ws(" / ", "job_role", "work_mode", "city"), limit=20)


@query("breakdown_fine")
def breakdown_fine(spark, d):
    # more groups than any report shows: none may be lost
    return bd.breakdown(scored(spark, d), F.concat_ws(" / ", "job_role", "work_mode", "city", "company_size"))


@query("roster_sort")
def roster_sort(spark, d):
    return ro.sort_roster(ro.roster_table(scored(spark, d)), "overtime", "asc")


@query("roster_page")
def roster_page(spark, d):
    return ro.roster_page(ro.roster_table(scored(spark, d)), page=3, page_size=50, sort_col="experience")


@query("roster_page_ranked")
def roster_page_ranked(spark, d):
    def lay_out():
        path = scratch_folder(spark)
        clustered.store_by_rank(ro.roster_table(scored(spark, d)), path, "experience")
        return path

    return clustered.page_by_rank(spark, _fitted(spark, d, "by_rank", lay_out), page=20, page_size=50)


@query("roster_page_after")
def roster_page_after(spark, d):
    table = ro.roster_table(scored(spark, d))
    return ro.roster_page_after(table, 25.0, "EM5", page_size=40, sort_col="hours", sort_dir="asc")


@query("hash_sample")
def hash_sample(spark, d):
    return sampling.hash_sample(staff(spark, d).select("employee_id", "stress_level", "strain_score"), 500)


@query("train_test_split")
def train_test_split(spark, d):
    return sampling.with_fold(sampling.with_split(staff(spark, d).select("employee_id")))


@query("stratified_split")
def stratified_split(spark, d):
    df = staff(spark, d).select("employee_id", bands.elevated("strain_score").alias("label"))
    return sampling.with_split(df, stratify="label")


# ------------------------------------------------------ evaluation and attribution
@query("regression_metrics")
def regression_metrics(spark, d):
    return ev.regression_metrics(judged(spark, d))


@query("roc_auc")
def roc_auc(spark, d):
    return ev.roc_auc(judged(spark, d), score="p")


@query("average_precision")
def average_precision(spark, d):
    return ev.average_precision(judged(spark, d), score="p")


@query("f1_at_half")
def f1_at_half(spark, d):
    return ev.f1_at(judged(spark, d))


@query("classification_metrics")
def classification_metrics(spark, d):
    return ev.classification_metrics(judged(spark, d))


@query("residuals")
def residuals(spark, d):
    r = ev.residuals(judged(spark, d), ["source_dataset", "employee_id"])
    return r.select("source_dataset", "employee_id", F.round("y", 4).alias("y"), "p",
                    F.round("residual", 4).alias("residual"))


@query("residual_histogram")
def residual_histogram(spark, d):
    return explore.histogram(ev.residuals(judged(spark, d), []), "residual", -10.0, 10.0, 40)


@query("roc_curve")
def roc_curve(spark, d):
    return ev.roc_curve(judged(spark, d), score="p")


@query("pr_curve")
def pr_curve(spark, d):
    return ev.pr_curve(judged(spark, d), score="p")


@query("confusion_matrix")
def confusion_matrix(spark, d):
    return ev.confusion_matrix(judged(spark, d))


@query("classification_report")
def classification_report(spark, d):
    return ev.classification_report(judged(spark, d))


@query("linear_attribution")
def linear_attribution(spark, d):
    return attribution.mean_attribution(master(spark, d), {c: w / s for c, w, s in STRAIN_WEIGHTS})


@query("permutation_importance")
def permutation_importance(spark, d):
    df = validate.labeled(master(spark, d)).withColumn(
        "row_id", F.concat("source_dataset", F.lit(":"), "employee_id"))
    filled_rows = align(df, defaults(spark, d), keep=["row_id", "strain_score"])
    return attribution.permutation_importance(
        filled_rows, scorer(spark, d), [c for c, _, _ in STRAIN_WEIGHTS], "strain_score", id_col="row_id")


@query("segment_naming")
def segment_naming(spark, d):
    centers = master(spark, d).groupBy("job_role", "work_mode").agg(*[
        F.round(F.avg(c), 3).alias(c) for c in models.SEGMENT_FEATURES])
    return centers.withColumn("employee_segment", models.segment_name(
        F.col("workload_index"), F.col("wellness_score"), F.col("strain_score")))


@query("numeric_statistics")
def numeric_statistics(spark, d):
    return models.numeric_statistics(canonical(spark, d)).select(
        "feature", *[F.round(c, 4).alias(c) for c in ("fill", "mean", "std")])


# ------------------------------------------------------- scenarios, what-if, report
@query("scenario_scores")
def scenario_scores(spark, d):
    return scoring.score_scenarios(fill_scenarios(_profiles(spark, d), defaults(spark, d), keep=["profile"]),
                                   scorer(spark, d), keep=["profile"])


@query("score_roster")
def score_roster(spark, d):
    return scored(spark, d).select("employee_id", F.round("score", 4).alias("score"),
                                   F.round("probability", 4).alias("probability"), "band")


@query("policy_whatif")
def policy_whatif(spark, d):
    told = policy.policy_whatif(filled(spark, d), scorer(spark, d))
    preset = F.concat_ws(",", F.transform(F.array_sort(F.map_entries("preset")), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))))
    return told.withColumn("preset", preset)


@query("employee_report")
def employee_report(spark, d):
    told = ro.employee_report(_found(spark, d), defaults(spark, d), scorer(spark, d))
    return told.select("id", "found_in", F.col("features.overtime_hours").alias("overtime_hours"),
                       F.col("features.company_size").alias("company_size"),
                       F.size("metadata").alias("known_fields"), F.col("metadata")["city"].alias("city"),
                       "strain_score", "elevated_risk_probability", "risk_band", "threshold")


# ------------------------------------------------------------------- fitted models
# The smaller of the two published sets of settings.
SIZES = {"trees": 100, "forest_depth": 12, "boost_rounds": 150, "boost_l2": 0.0, "sampled_rounds": 200, "sampled_depth": 6,
         "sampled_columns": 1.0}
# the calibrated, weighted classifier is published in one size
RISK_ROUNDS = 350
ROW_KEY = ("source_dataset", "employee_id")


def _prepared(spark, d):
    """Fitted preparation, and the vectors of all labelled rows, written once."""
    def fit():
        rows = sampling.with_split(validate.labeled(master(spark, d)))
        numeric, categorical = validate.by_type(rows, validate.model_columns(master(spark, d).columns, pipeline=True))
        prepare = models.fit_preprocessor(rows.where("split = 'train'"), numeric, categorical)
        kept = prepare.transform(rows).select("source_dataset", "employee_id", "strain_score", "split", "features")
        return prepare, write_scratch(kept)

    prepare, path = _fitted(spark, d, "prepared", fit)
    return prepare, spark.read.parquet(path)


def _model(spark, d, name):
    """One regressor at full settings, fitted once for all queries that use it."""
    def fit():
        _, rows = _prepared(spark, d)
        train = rows.where("split = 'train'")
        return {"model": models.regressors(train, id_cols=ROW_KEY, **SIZES)[name].fit(train)}

    return _fitted(spark, d, f"model_{name}", fit)["model"]


def _risk(spark, d):
    def fit():
        _, rows = _prepared(spark, d)
        train = rows.where("split = 'train'").withColumn("label", bands.elevated("strain_score"))
        return {"model": models.fit_risk(train, "label", rounds=RISK_ROUNDS)}

    return _fitted(spark, d, "risk", fit)["model"]


def _one_model(spark, d, name):
    _, rows = _prepared(spark, d)
    return models.measure(rows.where("split = 'test'"), {name: _model(spark, d, name)})


@query("preprocess_vector_stats")
def preprocess_vector_stats(spark, d):
    from pyspark.ml.functions import vector_to_array

    _, rows = _prepared(spark, d)
    names = models.feature_names(rows)
    cells = F.posexplode(vector_to_array("features")).alias("slot", "value")
    # train rows are centred by construction; the test rows show that the fitted values were used
    stats = rows.select("split", cells).groupBy("split", "slot").agg(
        (F.round(F.avg("value"), 4) + 0.0).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("std"))
    return stats.withColumn("feature", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("slot") + 1))


@query("reg_ridge")
def reg_ridge(spark, d):
    return _one_model(spark, d, "ridge")


@query("reg_forest")
def reg_forest(spark, d):
    return _one_model(spark, d, "random_forest")


@query("reg_gbt")
def reg_gbt(spark, d):
    return _one_model(spark, d, "gradient_boosting")


@query("reg_gbt_subsample")
def reg_gbt_subsample(spark, d):
    return _one_model(spark, d, "gradient_boosting_sampled")


@query("model_comparison")
def model_comparison(spark, d):
    _, rows = _prepared(spark, d)
    names = ("ridge", "random_forest", "gradient_boosting", "gradient_boosting_sampled")
    fitted = models.side_by_side(spark, {n: partial(_model, spark, d, n) for n in names})
    return models.measure(rows.where("split = 'test'"), fitted)


@query("best_model")
def best_model(spark, d):
    return models.best_model(model_comparison(spark, d))


@query("feature_importance")
def feature_importance(spark, d):
    _, rows = _prepared(spark, d)
    gains = _model(spark, d, "gradient_boosting_sampled").gains(models.feature_names(rows))
    return spark.createDataFrame(gains, "feature string, gain_importance double, total_gain double, splits long")


@query("tree_attribution")
def tree_attribution(spark, d):
    _, rows = _prepared(spark, d)
    return tree_shares.mean_shares(rows, _model(spark, d, "gradient_boosting_sampled"), models.feature_names(rows))


@query("boost_first_split")
def boost_first_split(spark, d):
    # one split of one tree over all labelled rows, gaps in the features included
    rows = validate.labeled(canonical(spark, d)).select(F.array(*MODEL_NUMERIC).alias("features"), "strain_score")
    model = boosting.Boosting(rounds=1, rate=1.0, leaves=2, l2=1.0, label="strain_score").fit(rows)
    nodes = spark.createDataFrame(model.nodes(), boosting.NODE)

    def of(node, c):
        return F.max(F.when(F.col("node") == node, F.col(c)))

    return nodes.agg(  # three nodes
        F.element_at(F.array(*[F.lit(c) for c in MODEL_NUMERIC]), of(0, "feature") + 1).alias("feature"),
        F.round(of(0, "threshold"), 6).alias("threshold"), of(0, "missing_left").alias("missing_left"), F.round(of(0, "gain"), 3).alias("gain"),
        *[of(i, "cover").cast("long").alias(f"{side}_rows") for i, side in ((1, "left"), (2, "right"))],
        *[F.round(of(i, "value"), 4).alias(f"{side}_value") for i, side in ((1, "left"), (2, "right"))])


@query("sketched_quantiles")
def sketched_quantiles(spark, d):
    columns, probs = [*TRACKED, "strain_score"], (0.25, 0.5, 0.75, 0.9)
    found = explore.approximate_quantiles(master(spark, d), columns, probs)
    return explore.rank_errors(master(spark, d), found, columns).select("metric", "prob", (F.col("error") <= 0.005).alias("within"))


@query("kmeans_step")
def kmeans_step(spark, d):
    rows = master(spark, d).where("workload_index is not null and wellness_score is not null and strain_score is not null")
    return clusters.kmeans_step(rows, models.SEGMENT_FEATURES, KMEANS_STARTS).select(
        "restart", "cluster", "rows", *[F.round(c, 4).alias(c) for c in models.SEGMENT_FEATURES])


@query("risk_probability")
def risk_probability(spark, d):
    _, rows = _prepared(spark, d)
    rows = rows.withColumn("label", bands.elevated("strain_score"))
    return _risk(spark, d).transform(rows.where("split = 'test'")).select(
        "source_dataset", "employee_id", "label", F.round("probability", 4).alias("probability"))


@query("score_roster_model")
def score_roster_model(spark, d):
    prepare, _ = _prepared(spark, d)
    fitted = models.model_scorer(prepare, _model(spark, d, "ridge"), _risk(spark, d))
    out = scoring.score_roster(roster(spark, d), defaults(spark, d), fitted)
    return out.select("employee_id", F.round("score", 4).alias("score"),
                      F.round("probability", 4).alias("probability"), "band")


@query("segment_employees")
def segment_employees(spark, d):
    return models.segment(master(spark, d)).select(
        "source_dataset", "employee_id", "cluster_id", "employee_segment")


# ----------------------------------------------------------------------- streaming
_STREAMED = ("employee_id", "work_hours_per_week", "overtime_hours", "meetings_per_day", "deadlines_missed",
             "experience_years", "job_role", "work_mode", "stress_level", "sleep_hours", "city")


def _stream(spark, d):
    """The roster as a file stream: its rows are written out once, in several files."""
    rows = roster(spark, d).select(*_STREAMED)
    path = _fitted(spark, d, "roster_files", lambda: write_scratch(rows.repartition(6)))
    stream = roster_stream.read_roster_stream(spark, path, rows.schema, fmt="parquet", files_per_trigger=2)
    return roster_stream.score_stream(stream, defaults(spark, d), scorer(spark, d))


@query("stream_score_roster")
def stream_score_roster(spark, d):
    place = scratch_folder(spark)
    run = roster_stream.append_scored(_stream(spark, d), f"{place}/out", f"{place}/state")
    run.awaitTermination()
    return spark.read.parquet(f"{place}/out").select("employee_id", F.round("score", 4).alias("score"), "band")


@query("stream_breakdown_role")
def stream_breakdown_role(spark, d):
    place = scratch_folder(spark)
    run = roster_stream.running_breakdown(_stream(spark, d), "job_role", f"{place}/out", f"{place}/state")
    run.awaitTermination()
    return roster_stream.latest_breakdown(spark, f"{place}/out")


@query("stream_reports")
def stream_reports(spark, d):
    """Every group report of the one running query; the fleet's row is :func:`stream_fleet`."""
    place = _running_reports(spark, d)
    return (roster_stream.latest_breakdown(spark, place).where("report <> 'fleet'")
            .select("report", "name", "grouped.*"))


@query("stream_fleet")
def stream_fleet(spark, d):
    return roster_stream.latest_report(spark, _running_reports(spark, d), "fleet")


def _running_reports(spark, d) -> str:
    place = scratch_folder(spark)
    located = bd.with_state(_stream(spark, d), city="city")
    roster_stream.running_reports(located, f"{place}/out", f"{place}/state").awaitTermination()
    return f"{place}/out"
