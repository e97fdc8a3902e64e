import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strainwise.functions import bands
from strainwise.operators import attribution, evaluate, models, sampling, scoring
from strainwise.registry import catalog
from strainwise.schema import STRAIN_WEIGHTS
from strainwise.sources import sinks


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(1)
    n = 600
    pdf = pd.DataFrame({"employee_id": [f"e{i}" for i in range(n)], "a": rng.normal(5, 2, n), "b": rng.normal(0, 3, n),
                        "t": rng.choice(["x", "y", "z"], n)})
    pdf["strain_score"] = (pdf.a * 0.8 - pdf.b * 0.3 + (pdf.t == "x") * 1.0 + rng.normal(0, 0.2, n)).clip(0, 10)
    pdf.loc[:40, "a"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                               "employee_id string, a double, b double, t string, strain_score double")
    return pdf, df.cache()


def matrix(pdf):
    x = pdf[["a", "b"]].fillna(pdf[["a", "b"]].median())
    x = (x - x.mean()) / x.std(ddof=0)
    return np.column_stack([x, *[(pdf.t == v).astype(float) for v in "xyz"]])


def test_prepared_vectors(toy, spark):
    pdf, df = toy
    prepare = models.fit_preprocessor(df, ["a", "b"], ["t"])
    out = prepare.transform(df)
    got = np.array([r["features"].toArray() for r in out.collect()])
    assert np.allclose(got, matrix(pdf))
    assert models.feature_names(out) == ["n_a", "n_b", "c_t_x", "c_t_y", "c_t_z"]
    unseen = spark.createDataFrame([("q", 5.0, 0.0, "new", 1.0)], df.schema)
    assert prepare.transform(unseen).first()["features"].toArray()[2:].tolist() == [0, 0, 0]


def test_rare_categories_share_a_slot(spark):
    rows = [(c, 1.0) for c in "aaaabbbccd"] + [(None, 2.0)]
    df = spark.createDataFrame(rows, "t string, a double")
    prepare = models.fit_preprocessor(df, ["a"], ["t"], max_categories=3)
    out = prepare.transform(df)
    assert models.feature_names(out) == ["n_a", "c_t_a", "c_t_b", "c_t_(other)"]
    by = {r["t"]: r["features"].toArray()[1:].tolist() for r in out.collect()}
    assert by["c"] == by["d"] == [0, 0, 1] and by[None] == by["a"] == [1, 0, 0]


def test_quotes_in_categories(spark):
    df = spark.createDataFrame([("o'neil", 1.0), ("back\\slash", 2.0), ("o'neil", 3.0), (None, 4.0)], "t string, a double")
    out = models.fit_preprocessor(df, ["a"], ["t"], max_categories=2).transform(df)
    assert out.count() == 4


def test_ridge_is_the_closed_form(toy):
    pdf, df = toy
    out = models.fit_preprocessor(df, ["a", "b"], ["t"]).transform(df)
    model = models.ridge(out, alpha=5.0).fit(out)
    x, y = matrix(pdf), pdf.strain_score.to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    beta = np.linalg.solve(xc.T @ xc + 5.0 * np.eye(x.shape[1]), xc.T @ yc)
    assert np.allclose(model.coefficients.toArray(), beta, atol=1e-6)


def test_comparison_and_best(toy):
    _, df = toy
    rows = sampling.with_split(models.fit_preprocessor(df, ["a", "b"], ["t"]).transform(df))
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    small = models.regressors(train, trees=5, forest_depth=4, boost_rounds=15, sampled_rounds=15, sampled_depth=3)
    metrics, fitted = models.compare(train, test, small)
    got = {r["model"]: r for r in metrics.collect()}
    assert set(got) == set(fitted) == set(small) and all(r["r2"] > 0.3 for r in got.values())
    assert models.best_model(metrics).first()["model"] == min(got, key=lambda m: got[m]["rmse"])
    pairs = models.importances(fitted["random_forest"], models.feature_names(rows))
    assert pairs[0][0] == "n_a" and abs(sum(v for _, v in pairs) - 1) < 1e-9


def test_models_are_fitted_side_by_side(toy, spark, monkeypatch):
    _, df = toy
    rows = sampling.with_split(models.fit_preprocessor(df, ["a", "b"], ["t"]).transform(df))
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")

    class Waiting:
        """Fits once all others are about to."""

        def __init__(self, alpha, others):
            self.alpha, self.others = alpha, others

        def fit(self, train):
            self.others.wait(60)
            return models.ridge(train, self.alpha).fit(train)

    meet = threading.Barrier(3)
    metrics, fitted = models.compare(train, test, {f"r{a}": Waiting(float(a), meet) for a in (1, 5, 500)})
    got = {r["model"]: r for r in metrics.collect()}
    assert list(fitted) == ["r1", "r5", "r500"] and set(got) == set(fitted)
    for name, alpha in (("r1", 1.0), ("r500", 500.0)):  # every model under its own name
        alone = models.measure(test, {name: models.ridge(train, alpha).fit(train)}).first()
        assert alone["rmse"] == pytest.approx(got[name]["rmse"])
    meet = threading.Barrier(4)
    monkeypatch.setattr(catalog, "_prepared", lambda spark, d: (None, rows))
    monkeypatch.setattr(catalog, "_model", lambda spark, d, name: Waiting(float(len(name)), meet).fit(train))
    names = {r["model"] for r in catalog.model_comparison(spark, "").collect()}
    assert names == {"ridge", "random_forest", "gradient_boosting", "gradient_boosting_sampled"}
    assert catalog.best_model(spark, "").count() == 1


def test_a_failed_fit_is_told(toy):
    _, df = toy
    rows = models.fit_preprocessor(df, ["a", "b"], ["t"]).transform(df)
    with pytest.raises(ValueError, match="bins"):
        models.compare(rows, rows, {"ridge": models.ridge(rows), "boosted": models.Boosting(bins=1, label="strain_score")})


def test_forest_keeps_the_nodes_of_rows(toy):
    _, df = toy
    rows = models.fit_preprocessor(df, ["a", "b"], ["t"]).transform(df).cache()
    forest = models.regressors(rows, trees=4, forest_depth=5)["random_forest"]
    assert forest.getCacheNodeIds()
    walked = forest.copy({forest.cacheNodeIds: False}).fit(rows)
    assert forest.fit(rows).toDebugString.split("\n")[1:] == walked.toDebugString.split("\n")[1:]


def test_calibrated_risk_and_saved_models(toy, tmp_path):
    _, df = toy
    prepare = models.fit_preprocessor(df, ["a", "b"], ["t"])
    rows = prepare.transform(df).withColumn("label", bands.elevated("strain_score"))
    risk = models.fit_risk(rows, "label", rounds=4, depth=3)
    out = risk.transform(rows)
    assert out.columns == [*rows.columns, "probability"] and len(risk.members) == 3
    r = evaluate.classification_metrics(out).first()
    mean = out.agg(F.avg("probability"), F.avg("label")).first()
    assert r["roc_auc"] > 0.9 and abs(mean[0] - mean[1]) < 0.05  # calibrated in the large
    risk.save(str(tmp_path / "risk"))
    again = models.CalibratedRisk.load(str(tmp_path / "risk")).transform(rows)
    key = ["employee_id", "probability"]
    assert again.select(key).exceptAll(out.select(key)).isEmpty()
    sinks.save_model(prepare, str(tmp_path / "prepare"))
    loaded = sinks.load_model(str(tmp_path / "prepare"))
    assert loaded.transform(df).first()["features"] == prepare.transform(df).first()["features"]
    reg = models.ridge(rows).fit(rows)
    scored = models.model_scorer(prepare, reg, risk)(df)
    assert scored.columns == [*df.columns, "score", "probability"]
    ends = scored.agg(F.min("score"), F.max("score")).first()
    assert 0 <= ends[0] and ends[1] <= 10
    plain = models.fit_risk(rows, "label", rounds=2, depth=2, calibrate=False, weighted=False)
    assert plain.transform(rows).count() == df.count()


def test_segments(spark):
    rng = np.random.default_rng(2)
    centers = [(80, 40, 8), (30, 80, 2), (30, 40, 4.5), (70, 70, 4.5)]
    rows = [tuple(float(v) for v in rng.normal(c, 0.5)) + (i,) for i, c in enumerate(centers) for _ in range(60)]
    df = spark.createDataFrame(rows, "workload_index double, wellness_score double, strain_score double, truth int")
    got = {(r["truth"], r["employee_segment"]) for r in models.segment(df, restarts=4).select("truth", "employee_segment").distinct().collect()}
    assert got == {(0, "Overloaded (At Risk)"), (1, "Healthy & Balanced"), (2, "Disengaged"), (3, "Moderate / Transitioning")}


def test_linear_attribution_sums_to_the_gap(spark):
    df = spark.createDataFrame([(1.0, 10.0), (3.0, 20.0), (8.0, 60.0)], "a double, b double")
    w = {"a": 2.0, "b": -0.5}
    out = attribution.linear_attribution(df, w).collect()
    base = sum(w["a"] * r["a"] + w["b"] * r["b"] for r in out) / 3
    for r in out:
        assert r["attr_a"] + r["attr_b"] == pytest.approx(w["a"] * r["a"] + w["b"] * r["b"] - base)


def test_shuffled_features_keep_the_values(spark):
    df = spark.range(300).selectExpr("concat('e', id) employee_id", "cast(id as double) x")
    draws = []
    for part_rows in (10 ** 6, 40):  # one partition, and eight
        out = attribution.shuffled_features(df, ["x"], part_rows=part_rows)
        pairs = sorted((r["x"], r["other_x"]) for r in out.collect())
        assert sorted(a for a, _ in pairs) == sorted(b for _, b in pairs)
        assert not any(a == b for a, b in pairs)
        draws.append(pairs)
    assert draws[0] == draws[1]  # the draw does not depend on the partitions


def test_permutation_importance_finds_the_used_feature(spark):
    names = [c for c, _, _ in STRAIN_WEIGHTS]
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({c: rng.normal(5, 0.01, 400) for c in names})
    pdf["stress_level"] = rng.uniform(1, 10, 400)
    pdf["employee_id"] = [f"e{i}" for i in range(400)]
    df = spark.createDataFrame(pdf)
    scorer = scoring.linear_scorer(df)
    truth = scorer(df).withColumnRenamed("score", "y").drop("probability")
    top = attribution.permutation_importance(truth, scorer, names, "y", part_rows=100).first()
    assert top["feature"] == "stress_level" and top["rmse_rise"] > 1


def test_risk_folds_share_rare_positives(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors
    from strainwise.operators import models as m

    rows = [(i, Vectors.dense([float(i % 7), float(i % 25 == 0)]), int(i % 25 == 0)) for i in range(300)]
    seen, fit = [], m._sigmoid

    def counted(held_out, label):
        seen.append(held_out.where(f"{label} = 1").count())
        return fit(held_out, label)

    monkeypatch.setattr(m, "_sigmoid", counted)
    m.fit_risk(spark.createDataFrame(rows, ["employee_id", "features", "risk"]), "risk", rounds=1, depth=1)
    assert seen == [4, 4, 4]


def test_free_text_is_no_indicator(spark):
    df = spark.range(300).selectExpr("cast(id as double) a", "concat('said ', id) t", "'x' k")
    with pytest.raises(ValueError, match=r"more than 100 distinct values: t \(300\)"):
        models.frequent_values(df, ["t", "k"], None, most=100)
    assert len(models.frequent_values(df, ["t", "k"], None, most=300)["t"]) == 300
    top = models.frequent_values(df, ["t", "k"], 4, most=100)  # with a limit any column will do
    assert len(top["t"]) == 5 and top["k"] == ["x"]
