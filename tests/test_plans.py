"""Exact quantiles and running totals against numpy, with hot groups and hot values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strainwise.operators import evaluate, explore, sampling
from strainwise.plans.quantiles import exact_quantiles
from strainwise.plans.running import running_totals


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 9000
    pdf = pd.DataFrame({
        "g": np.where(rng.random(n) < 0.5, "hot", rng.choice(["a", "b", "c"], n)),
        "x": np.where(rng.random(n) < 0.34, 7.0, rng.lognormal(0, 3, n)),  # one value holds a third
        "y": rng.normal(0, 1, n),
    })
    pdf.loc[rng.random(n) < 0.1, "y"] = np.nan
    pdf.loc[pdf.g == "c", "y"] = np.nan  # a group without values
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g string, x double, y double")
    return pdf, df.repartition(7)


PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


# values in one partition, and in many
PARTS = [10 ** 6, 700]


@pytest.mark.parametrize("part_rows", PARTS)
def test_quantiles(skewed, part_rows):
    pdf, df = skewed
    out = exact_quantiles(df, ["x", "y"], PROBS, by="g", with_total=True, part_rows=part_rows)
    rows = out.collect()
    assert len(rows) == 5
    for r in rows:
        part = pdf if r["is_total"] else pdf[pdf.g == r["g"]]
        for c in ("x", "y"):
            values = part[c].dropna()
            if values.empty:
                assert not r[c]
            else:
                assert np.allclose(r[c], np.quantile(values, PROBS)), (r["g"], c)


def test_no_raw_row_is_shuffled_for_a_quantile(skewed):
    text = exact_quantiles(skewed[1], ["x"], [0.5], by="g")._jdf.queryExecution().toString()
    assert "percentile" not in text


@pytest.mark.parametrize("part_rows", PARTS)
def test_quantiles_ungrouped(skewed, part_rows):
    pdf, df = skewed
    r = exact_quantiles(df, ["x", "y"], PROBS, part_rows=part_rows).first()
    assert np.allclose(r["x"], np.quantile(pdf.x, PROBS)) and np.allclose(r["y"], np.quantile(pdf.y.dropna(), PROBS))


@pytest.mark.parametrize("part_rows", [10 ** 6, 1])
def test_known_quantiles(spark, part_rows):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (10.0,), (None,)], "v double")
    r = exact_quantiles(df, ["v"], [0.5, 0.9], part_rows=part_rows).first()
    assert [round(x, 9) for x in r["v"]] == [3.0, 7.6]


def test_all_null_column(spark):
    df = spark.sql("select cast(null as double) v, 'a' g union all select null, 'b'")
    assert not exact_quantiles(df, ["v"], [0.5]).first()["v"]


def test_running_totals(spark):
    rng = np.random.default_rng(5)
    score = np.where(rng.random(5000) < 0.4, 0.5, np.round(rng.random(5000), 3))
    df = spark.createDataFrame(pd.DataFrame({"s": score, "one": 1}))
    got = running_totals(df, "s", ["one"], part_rows=90).orderBy(F.desc("s")).toPandas()
    counts = pd.Series(score).value_counts().sort_index(ascending=False)
    assert np.array_equal(got.s, counts.index) and np.array_equal(got.one, counts.values)
    assert np.array_equal(got.cum_one, counts.cumsum()) and (got.all_one == 5000).all()
    assert np.array_equal(got.next_one.dropna(), counts.values[1:]) and got.next_one.isna().sum() == 1


@pytest.fixture(scope="module")
def judged(spark):
    rng = np.random.default_rng(11)
    n = 3000
    y = (rng.random(n) < 0.3).astype(int)
    p = np.clip(np.round(0.3 * y + 0.7 * rng.random(n), 2), 0, 1)
    p[: n // 3] = 0.5  # a third of all rows share one score
    pdf = pd.DataFrame({"label": y, "probability": p})
    return pdf, spark.createDataFrame(pdf)


def brute_auc(pdf):
    pos, neg = (pdf.probability[pdf.label == v].to_numpy() for v in (1, 0))
    d = pos[:, None] - neg[None, :]
    return ((d > 0).sum() + 0.5 * (d == 0).sum()) / d.size


def brute_ap(pdf):
    out, last = 0.0, 0.0
    for t in sorted(pdf.probability.unique(), reverse=True):
        hit = pdf[pdf.probability >= t]
        recall, precision = hit.label.sum() / pdf.label.sum(), hit.label.mean()
        out, last = out + (recall - last) * precision, recall
    return out


def test_classification_metrics(judged):
    pdf, df = judged
    r = evaluate.classification_metrics(df).first()
    predicted = (pdf.probability >= 0.5).astype(int)
    tp = int((predicted & pdf.label).sum())
    f1 = 2 * tp / (predicted.sum() + pdf.label.sum())
    assert r["roc_auc"] == pytest.approx(brute_auc(pdf), abs=1e-4)
    assert r["pr_auc"] == pytest.approx(brute_ap(pdf), abs=1e-4)
    assert r["f1_at_0_5"] == pytest.approx(f1, abs=1e-4)
    assert r["positive_rate"] == pytest.approx(pdf.label.mean(), abs=1e-4)
    assert evaluate.roc_auc(df, score="probability").first()[0] == r["roc_auc"]


def test_roc_curve_is_the_whole_curve(judged):
    pdf, df = judged
    full = evaluate.roc_curve(df, score="probability", drop_intermediate=False).toPandas()
    kept = evaluate.roc_curve(df, score="probability").toPandas()
    assert len(full) == pdf.probability.nunique() + 1 and len(kept) <= len(full)
    for curve in (full, kept):
        c = curve.sort_values(["fpr", "tpr"])
        area = np.trapezoid(c.tpr, c.fpr)
        assert area == pytest.approx(brute_auc(pdf), abs=1e-4)
        assert c.iloc[-1].fpr == c.iloc[-1].tpr == 1.0


def test_pr_curve(judged):
    pdf, df = judged
    c = evaluate.pr_curve(df, score="probability").toPandas().set_index("threshold")
    hit = pdf[pdf.probability >= 0.5]
    assert c.loc[0.5, "precision"] == pytest.approx(hit.label.mean(), abs=1e-6)
    assert c.recall.max() == 1.0 and c.precision[c.index.isna()].tolist() == [1.0]


def test_split_is_stable_under_repartition(spark):
    df = spark.range(4000).selectExpr("concat('e', id) employee_id", "id % 10 = 0 hot")
    a = sampling.with_split(df).where("split = 'test'")
    b = sampling.with_split(df.repartition(13)).where("split = 'test'")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert 0.17 < a.count() / 4000 < 0.23


def test_stratified_split_is_exact(spark):
    df = spark.range(1003).selectExpr("concat('e', id) employee_id", "case when id < 901 then 'x' when id < 1000 then 'y' end s")
    got = sampling.with_split(df, stratify="s").groupBy("s", "split").count().collect()
    sizes = {(r["s"], r["split"]): r["count"] for r in got}
    assert sizes == {("x", "test"): 181, ("x", "train"): 720, ("y", "test"): 20, ("y", "train"): 79,
                     (None, "test"): 1, (None, "train"): 2}


def test_stratified_folds_share_every_stratum(spark):
    df = spark.range(907).selectExpr("concat('e', id) employee_id", "id % 100 = 0 hot")
    got = sampling.with_fold(df, folds=3, stratify="hot").groupBy("hot", "fold").count().collect()
    assert len(got) == 6 and all(r["count"] in ((3, 4) if r["hot"] else range(297, 302)) for r in got)


def test_hash_sample(spark):
    df = spark.range(500).selectExpr("concat('e', id) employee_id")
    a = {r[0] for r in sampling.hash_sample(df, 40).collect()}
    assert len(a) == 40 and a == {r[0] for r in sampling.hash_sample(df.repartition(9), 40).collect()}


def test_histogram_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.5, 1.0, 9.99, 10.0, 10.1, -0.1, None)], "v double")
    rows = explore.histogram(df, "v", 0.0, 10.0, 10).orderBy("bin").collect()
    assert [r["rows"] for r in rows] == [1, 2, 1, 0, 0, 0, 0, 0, 0, 0, 2, 1]
    assert (rows[0]["bin"], rows[0]["low"], rows[-1]["high"]) == (-1, None, None)
