"""Regression and classification measures, all as aggregates over (label, score)."""

from pyspark.sql import DataFrame, functions as F

from ..plans.running import running_totals

CLASS_NAMES = ("Standard Risk", "Elevated Risk")


def regression_metrics(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """MAE, RMSE and R2 to 4 places, one row."""
    return df.agg(*_regression(y, p))


def _regression(y, p) -> list:
    e = F.col(y) - F.col(p)
    pairs = F.when(F.col(p).isNotNull(), F.col(y))
    return [
        F.round(F.avg(F.abs(e)), 4).alias("mae"),
        F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"),
        F.round(1.0 - F.try_divide(F.avg(e * e), F.var_pop(pairs)), 4).alias("r2"),
    ]


def regression_metrics_by(df: DataFrame, by: str, y: str = "y", p: str = "p") -> DataFrame:
    return df.groupBy(by).agg(*_regression(y, p))


def residuals(df: DataFrame, keep, y: str = "y", p: str = "p") -> DataFrame:
    return df.select(*keep, y, p, (F.col(y) - F.col(p)).alias("residual"))


def _thresholds(df: DataFrame, label: str, score: str) -> DataFrame:
    """Per distinct score, highest first: positives/negatives here, so far, in all, and next."""
    marked = df.where(F.col(label).isNotNull()).select(
        score, F.col(label).cast("bigint").alias("pos"), (1 - F.col(label)).cast("bigint").alias("neg"))
    return running_totals(marked, score, ["pos", "neg"])


def _area():
    wins = F.sum(F.col("neg").cast("double") * (F.col("cum_pos") - F.col("pos") / 2.0))
    return F.round(F.try_divide(wins, F.max("all_pos").cast("double") * F.max("all_neg")), 4)


def _average_precision():
    step = F.col("pos") * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    return F.round(F.try_divide(F.sum(step), F.max("all_pos")), 4)


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve; tied scores count half."""
    return _thresholds(df, label, score).agg(_area().alias("roc_auc"))


def average_precision(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Sum over thresholds of recall step times precision."""
    return _thresholds(df, label, score).agg(_average_precision().alias("average_precision"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score", drop_intermediate: bool = True) -> DataFrame:
    """ROC points by falling threshold, from the origin (threshold +inf).

    ``drop_intermediate`` leaves out points on a straight line between neighbours.
    """
    t = _thresholds(df, label, score)
    if drop_intermediate:
        bend = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        t = t.where(F.col("next_pos").isNull() | bend)
    points = t.select(
        F.col(score).cast("double").alias("threshold"),
        F.round(F.try_divide(F.col("cum_neg"), F.col("all_neg")), 6).alias("fpr"),
        F.round(F.try_divide(F.col("cum_pos"), F.col("all_pos")), 6).alias("tpr"))
    origin = df.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def pr_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Precision-recall points per threshold, plus the end point (recall 0, precision 1)."""
    t = _thresholds(df, label, score)
    points = t.select(
        F.col(score).cast("double").alias("threshold"),
        F.round(F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")), 6).alias("precision"),
        F.round(F.coalesce(F.try_divide(F.col("cum_pos"), F.col("all_pos")), F.lit(1.0)), 6).alias("recall"))
    end = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def _cells(df: DataFrame, label: str, predicted: str) -> DataFrame:
    y, p = F.col(label), F.col(predicted)
    return df.agg(
        F.count(F.when((y == 0) & (p == 0), 1)).alias("tn"), F.count(F.when((y == 0) & (p == 1), 1)).alias("fp"),
        F.count(F.when((y == 1) & (p == 0), 1)).alias("fn"), F.count(F.when((y == 1) & (p == 1), 1)).alias("tp"))


def confusion_matrix(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """All four cells: ``actual, predicted, rows``."""
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    return _cells(df, label, predicted).select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(c).alias("rows"))
        for a, b, c in cells])))


def _f1(tp, fp, fn):
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))


def f1_at(df: DataFrame, label: str = "label", probability: str = "probability", cut: float = 0.5) -> DataFrame:
    """F1 of ``probability >= cut`` and the positive rate."""
    marked = df.select(label, (F.col(probability) >= cut).cast("int").alias("_p"))
    y = F.col(label)
    c = _cells(marked, label, "_p")
    rate = F.try_divide((F.col("tp") + F.col("fn")).cast("double"), F.col("tp") + F.col("fn") + F.col("tn") + F.col("fp"))
    return c.select(F.round(_f1(F.col("tp"), F.col("fp"), F.col("fn")), 4).alias("f1"),
                    F.round(rate, 4).alias("positive_rate"))


def classification_metrics(df: DataFrame, label: str = "label", probability: str = "probability") -> DataFrame:
    """ROC-AUC, average precision, F1 at 0.5 and positive rate in one row."""
    t = _thresholds(df, label, probability)
    p = F.col(probability)
    tp, fp, fn = (F.coalesce(F.sum(x), F.lit(0)) for x in (
        F.when(p >= 0.5, F.col("pos")), F.when(p >= 0.5, F.col("neg")), F.when(p < 0.5, F.col("pos"))))
    return t.agg(
        _area().alias("roc_auc"), _average_precision().alias("pr_auc"),
        F.round(_f1(tp, fp, fn), 4).alias("f1_at_0_5"),
        F.round(F.try_divide(F.sum("pos").cast("double"), F.sum(F.col("pos") + F.col("neg"))), 4).alias("positive_rate"))


def classification_report(df: DataFrame, label: str = "label", predicted: str = "predicted",
                          names=CLASS_NAMES, digits: int = 4) -> DataFrame:
    """Precision, recall, F1, support per class, then accuracy, macro and weighted averages."""
    c = _cells(df, label, predicted)
    tn, fp, fn, tp = (F.col(x).cast("double") for x in ("tn", "fp", "fn", "tp"))

    def part(a, b):
        return F.coalesce(F.try_divide(a, a + b), F.lit(0.0))

    zero = {"precision": part(tn, fn), "recall": part(tn, fp), "f1": _f1(tn, fn, fp), "support": tn + fp}
    one = {"precision": part(tp, fp), "recall": part(tp, fn), "f1": _f1(tp, fp, fn), "support": tp + fn}
    rows = tn + fp + fn + tp
    accuracy = F.try_divide(tn + tp, rows)
    nothing = F.lit(None).cast("double")

    def line(name, precision, recall, f1, support):
        return F.struct(F.lit(name).alias("class"), F.round(precision, digits).alias("precision"),
                        F.round(recall, digits).alias("recall"), F.round(f1, digits).alias("f1"),
                        support.cast("bigint").alias("support"))

    macro = [(zero[k] + one[k]) / 2.0 for k in ("precision", "recall", "f1")]
    weighted = [F.try_divide(zero[k] * zero["support"] + one[k] * one["support"], rows)
                for k in ("precision", "recall", "f1")]
    return c.select(F.inline(F.array(
        line(names[0], *zero.values()), line(names[1], *one.values()),
        line("accuracy", nothing, nothing, accuracy, rows),
        line("macro avg", *macro, rows), line("weighted avg", *weighted, rows))))
