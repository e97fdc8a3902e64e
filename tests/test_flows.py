import pytest
from pyspark.sql import functions as F

from strainwise.operators.align import fit_defaults
from strainwise.operators.scoring import linear_scorer
from strainwise.plans import flows
from strainwise.registry import catalog
from strainwise.sources import readers
from strainwise.schema import FOREIGN_HEADERS, LAYOUT_FILES, RAW_TYPES


@pytest.fixture(scope="module")
def master(spark, sf, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("raw"))
    staff = catalog.staff(spark, sf)
    foreign = {v: k for k, v in FOREIGN_HEADERS.items()}
    raw = staff.toDF(*[foreign.get(c, c) for c in staff.columns])
    raw.select(*RAW_TYPES["tech"].names).coalesce(1).write.option("header", True).csv(f"{folder}/{LAYOUT_FILES['tech']}")
    return flows.build_master(spark, folder, f"{folder}/master", restarts=2), staff


def test_master(spark, master):
    table, staff = master
    assert table.count() == staff.count()
    assert table.where("sleep_hours is null or overtime_hours is null or workload_index is null").isEmpty()
    assert table.select("cluster_id").distinct().count() == 4
    assert table.agg(F.max("strain_score")).first()[0] <= 10.0


def test_train_and_roster(spark, sf, master, tmp_path):
    table, _ = master
    fitted = flows.train(table, str(tmp_path / "models"), risk_rounds=2, risk_depth=2, trees=3, forest_depth=3,
                         boost_rounds=2, sampled_rounds=2, sampled_depth=3)
    assert fitted.comparison.count() == 4
    assert 0.5 <= fitted.risk_metrics.first()["roc_auc"] <= 1
    assert readers.read_threshold(spark, str(tmp_path / "models" / "metrics")) == fitted.threshold
    doc = spark.read.json(str(tmp_path / "models" / "metrics")).first()
    assert doc["risk_model"]["roc_auc"] == fitted.risk_metrics.first()["roc_auc"] and doc["dataset"]["test_rows"] > 0
    assert "employee_id" in doc["dataset"]["features_excluded"]
    assert "stress_level" not in doc["dataset"]["features_used"] and "employee_id" not in doc["dataset"]["features_used"]
    reports = flows.analyse_roster(catalog.roster(spark, sf), fit_defaults(table), fitted.scorer(), fitted.threshold)
    n = catalog.roster(spark, sf).count()
    assert reports["table"].count() == n and reports["summary"].first()["employees"] == n
    assert reports["policies"].count() == 4


def test_roster_with_headers_as_people_write_them(spark, sf, master):
    table, _ = master
    r = catalog.roster(spark, sf)
    messy = r.select([F.col(c).alias(" " + c.replace("_", " ").title()) for c in r.columns if c != "caffeine_intake"])
    messy = messy.withColumnRenamed(" City", "Employee_Location").withColumnRenamed(" Gender", "SEX")
    reports = flows.analyse_roster(messy, fit_defaults(table), linear_scorer(table), 4.5, cleaned=True)
    assert {"cities", "states", "genders"} <= set(reports)
    names = {x["name"] for x in reports["roles"].collect()}
    assert names == {"Software Engineer", "Devops", "Qa Engineer", "Full-Stack Dev", "Unknown"}
    assert reports["states"].count() == 3  # three cities in the dictionary lie in three states
    with pytest.raises(ValueError, match="lacks these columns"):
        flows.analyse_roster(r.drop("work_mode"), fit_defaults(table), linear_scorer(table), 4.5)
