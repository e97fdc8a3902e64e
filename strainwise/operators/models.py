"""Model preparation, regressors, calibrated risk classifier and segmentation on MLlib."""

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.numbers import clip
from ..plans.bounds import materialize
from ..plans.quantiles import exact_medians
from ..schema import MODEL_CATEGORICAL, MODEL_NUMERIC, SEED, SEGMENTS, TARGET
from .boosting import BoostedTrees, Boosting
from .clusters import kmeans, nearest
from .evaluate import regression_metrics_by
from .sampling import with_fold
from .scoring import Scorer

OTHER = "(other)"
# Distinct values of a column that may each become an indicator.
MOST_VALUES = 10_000
SEGMENT_FEATURES = ("workload_index", "wellness_score", "strain_score")


# ------------------------------------------------------------------ preparation
def numeric_statistics(df: DataFrame, numeric=MODEL_NUMERIC) -> DataFrame:
    """Fill value, then mean and population std of the filled column: one row per feature."""
    numeric = list(numeric)
    medians = exact_medians(df, numeric).first()
    fills = {c: medians[c] if medians[c] is not None else 0.0 for c in numeric}
    stats = df.agg(*[
        F.struct(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std")).alias(c)
        for c in numeric for x in [F.coalesce(F.col(c), F.lit(fills[c]))]])
    return stats.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(float(fills[c])).alias("fill"), F.col(c)["mean"].alias("mean"),
                 F.col(c)["std"].alias("std")) for c in numeric])))


def frequent_values(df: DataFrame, columns, limit: int | None, most: int = MOST_VALUES) -> dict:
    """Most frequent values per column, best first (smallest on ties), from one pass.

    With a ``limit`` at most ``limit + 1`` values per column are fetched. Without one all of
    them are, which an indicator column per value needs anyway; a column with over ``most``
    distinct values, such as free text, is refused before anything is fetched.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in columns]))
    counts = materialize(df.select(pairs.alias("p")).where("p.v is not null").groupBy("p.k", "p.v").count())
    if limit is None:
        wide = {r["k"]: r["n"] for r in counts.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).collect()}
        if wide:
            told = ", ".join(f"{c} ({n})" for c, n in sorted(wide.items()))
            raise ValueError(f"more than {most} distinct values: {told}; leave the column out or set max_categories")
    else:
        # the best of every task go on, so a column's values never meet in one place
        order = Window.partitionBy("k").orderBy(F.desc("count"), "v")
        counts = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit + 1)
    rows = sorted(counts.collect(), key=lambda r: (-r["count"], r["v"]))
    return {c: [r["v"] for r in rows if r["k"] == c] for c in columns}


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fit_preprocessor(df: DataFrame, numeric=MODEL_NUMERIC, categorical=MODEL_CATEGORICAL,
                     max_categories: int | None = None, output: str = "features", stats=None) -> PipelineModel:
    """Median fill + standardise, mode fill + indicators (unknown values: all zeros).

    Over ``max_categories`` values, all but the most frequent share one indicator.
    Every stage is a stock, saveable transformer; the numeric part is plain SQL.
    """
    stats = stats or numeric_statistics(df, numeric).collect()  # one row per feature
    values = frequent_values(df, categorical, max_categories) if categorical else {}
    parts, names, labels = [], [], []
    for r in stats:
        std = r["std"] if r["std"] else 1.0
        parts.append(f"(coalesce(`{r['feature']}`, {r['fill']!r}D) - {r['mean']!r}D) / {std!r}D AS `n_{r['feature']}`")
        names.append(f"n_{r['feature']}")
    for c in categorical:
        ranked = values[c]
        filled = f"coalesce(`{c}`, {_text(ranked[0])})" if ranked else f"`{c}`"
        known = sorted(ranked)
        if max_categories is not None and len(ranked) > max_categories:
            known = sorted(ranked[: max_categories - 1])
            listed = ", ".join(_text(v) for v in known)
            filled = f"CASE WHEN {filled} IN ({listed}) THEN {filled} ELSE {_text(OTHER)} END"
            known = known + [OTHER]
        parts.append(f"{filled} AS `t_{c}`")
        labels.append(known or [OTHER])
    sql = SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")
    stages: list = [sql]
    prepared = [f"t_{c}" for c in categorical]
    if categorical:
        # one model per column: label lists differ in length
        index = [StringIndexerModel.from_labels(known, inputCol=t, outputCol=f"i_{c}", handleInvalid="keep")
                 for known, t, c in zip(labels, prepared, categorical)]
        encode = OneHotEncoder(inputCols=[f"i_{c}" for c in categorical],
                               outputCols=[f"c_{c}" for c in categorical], dropLast=True)
        stages += [*index, encode]
    stages.append(VectorAssembler(inputCols=names + [f"c_{c}" for c in categorical], outputCol=output))
    # the encoder only reads the label lists from the column metadata
    return Pipeline(stages=stages).fit(df.limit(1))


def feature_names(df: DataFrame, column: str = "features") -> list:
    """Names of the assembled vector's slots, in order."""
    attrs = df.schema[column].metadata["ml_attr"]["attrs"]
    slots = [a for kind in attrs.values() for a in kind]
    return [a["name"] for a in sorted(slots, key=lambda a: a["idx"])]


# ------------------------------------------------------------------- regressors
def ridge(df: DataFrame, alpha: float = 5.0, label: str = TARGET) -> LinearRegression:
    """Least squares with an L2 penalty ``alpha`` on the summed squared error.

    MLlib averages the loss and scales the label by its spread, so the penalty is
    divided by the row count and multiplied by that spread.
    """
    row = df.agg(F.stddev_pop(label).alias("s"), F.count(label).alias("n")).first()
    return LinearRegression(labelCol=label, elasticNetParam=0.0, solver="normal", standardization=False,
                            regParam=alpha * (row["s"] or 1.0) / max(row["n"], 1))


def regressors(df: DataFrame, label: str = TARGET, trees: int = 160, forest_depth: int = 16,
               boost_rounds: int = 250, boost_l2: float = 1.0, sampled_rounds: int = 500, sampled_depth: int = 7,
               sampled_columns: float = 0.9, id_cols=()) -> dict:
    """The four compared estimators; defaults are the full-size settings.

    ``gradient_boosting`` grows trees of 31 leaves, best gain first; ``gradient_boosting_sampled``
    is of second order, grows level by level and draws rows (by ``id_cols``) and columns per tree.
    """
    return {
        "ridge": ridge(df, label=label),
        # every row's nodes are kept: no pass walks its rows down all trees again
        "random_forest": RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=forest_depth,
                                               minInstancesPerNode=3, seed=SEED, cacheNodeIds=True),
        "gradient_boosting": Boosting(rounds=boost_rounds, rate=0.07, leaves=31, l2=boost_l2, label=label),
        "gradient_boosting_sampled": Boosting(rounds=sampled_rounds, rate=0.05, growth="level", depth=sampled_depth, l2=1.0,
                                              min_rows=1, min_hessian=1.0, rows=0.85, columns=sampled_columns, label=label,
                                              id_cols=tuple(id_cols)),
    }


def predicted(model, df: DataFrame, output: str) -> DataFrame:
    """Append a fitted regressor's prediction as ``output``."""
    if isinstance(model, BoostedTrees):
        return model.transform(df, output)
    return model.copy({model.predictionCol: output}).transform(df)


def save_regressor(model, path: str) -> None:
    if isinstance(model, BoostedTrees):
        model.save(SparkSession.active(), path)
    else:
        model.write().overwrite().save(path)


def side_by_side(spark: SparkSession, fits: dict) -> dict:
    """Results of functions that each fit a model, by name; their jobs share the cluster.

    A boosted model is a long chain of short passes, each of which leaves most cores idle.
    """
    with ThreadPoolExecutor(max(1, len(fits))) as pool:
        running = {name: pool.submit(inheritable_thread_target(spark)(fit)) for name, fit in fits.items()}
        return {name: one.result() for name, one in running.items()}


def compare(train: DataFrame, test: DataFrame, estimators: dict, label: str = TARGET) -> tuple:
    """Fit the estimators on prepared rows, side by side; returns (metrics per model, fitted models).

    The metrics frame has ``model, mae, rmse, r2``; all models are scored in one
    pass over the test rows. ``features`` must exist already.
    """
    fitted = side_by_side(train.sparkSession, {name: partial(e.fit, train) for name, e in estimators.items()})
    return measure(test, fitted, label), fitted


def measure(test: DataFrame, fitted: dict, label: str = TARGET) -> DataFrame:
    """``model, mae, rmse, r2`` of fitted models, from one pass over the test rows."""
    scored = test.select("features", F.col(label).alias("y"))
    for name, model in fitted.items():
        scored = predicted(model, scored, f"p_{name}")
    long = scored.select("y", F.explode(F.array(*[
        F.struct(F.lit(n).alias("model"), F.col(f"p_{n}").alias("p")) for n in fitted])).alias("m"))
    return regression_metrics_by(long.select("y", "m.*"), "model")


def best_model(comparison: DataFrame) -> DataFrame:
    return comparison.orderBy("rmse", "model").limit(1)


def importances(model, names) -> list:
    """(feature, importance) pairs, highest first; one entry per vector slot.

    Of a boosted model: shares of the mean gain of a feature's splits.
    """
    if isinstance(model, BoostedTrees):
        return [(name, mean) for name, mean, _, _ in model.gains(names)]
    values = model.featureImportances.toArray()
    return sorted(((n, float(v)) for n, v in zip(names, values)), key=lambda x: (-x[1], x[0]))


# --------------------------------------------------------------- risk classifier
class CalibratedRisk:
    """Mean of sigmoid-calibrated classifiers, one per left-out fold."""

    def __init__(self, model: BoostedTrees, sigmoids):
        self.model, self.members = model, list(sigmoids)  # (slope, intercept) per model

    def transform(self, df: DataFrame, output: str = "probability") -> DataFrame:
        out, parts = df, []
        for i, (slope, intercept) in enumerate(self.members):
            parts.append(f"_p{i}")
            kept = out.columns
            out = self.model.transform(out, "_margin", i)
            out = out.select(*kept, (1.0 / (1.0 + F.exp(-(F.lit(slope) * F.col("_margin") + F.lit(intercept))))).alias(f"_p{i}"))
        mean = reduce(lambda a, b: a + b, [F.col(p) for p in parts]) / float(len(parts))
        return out.withColumn(output, mean).drop(*parts)

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.model.save(spark, f"{path}/margin")
        rows = [(i, slope, intercept) for i, (slope, intercept) in enumerate(self.members)]
        spark.createDataFrame(rows, "model int, slope double, intercept double").coalesce(1).write.mode("overwrite").parquet(f"{path}/sigmoid")

    @classmethod
    def load(cls, path: str) -> "CalibratedRisk":
        spark = SparkSession.active()
        rows = sorted(spark.read.parquet(f"{path}/sigmoid").collect())  # one row per fold
        return cls(BoostedTrees.load(spark, f"{path}/margin"), [(r["slope"], r["intercept"]) for r in rows])


def _sigmoid(margins: DataFrame, label: str):
    """Logistic fit of the label on the margin, with targets pulled off 0 and 1.

    A soft target t is a row of label 1 with weight t and one of label 0 with 1 - t.
    """
    n = margins.agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg")).first()
    high, low = (n["pos"] + 1.0) / (n["pos"] + 2.0), 1.0 / (n["neg"] + 2.0)
    target = F.when(F.col(label) == 1, high).otherwise(low)
    both = margins.withColumn("_t", target).select("_margin", F.explode(F.array(
        F.struct(F.lit(1.0).alias("y"), F.col("_t").alias("w")),
        F.struct(F.lit(0.0).alias("y"), (1.0 - F.col("_t")).alias("w")))).alias("s"))
    ready = VectorAssembler(inputCols=["_margin"], outputCol="margins").transform(
        both.select("_margin", "s.*"))
    return LogisticRegression(featuresCol="margins", labelCol="y", weightCol="w", regParam=0.0,
                              standardization=False, maxIter=100).fit(ready)


def fit_risk(train: DataFrame, label: str, id_col: str = "employee_id", folds: int = 3, rounds: int = 350,
             depth: int = 6, calibrate: bool = True, weighted: bool = True):
    """Class-weighted boosted classifier of second order; with ``calibrate``, sigmoid-calibrated over folds.

    ``train`` holds prepared ``features`` and a 0/1 ``label``. Every fold has
    its share of positives: rows are stored once, and cut by id hash within each label. The
    models of all folds grow side by side, in the same passes over the rows.
    """
    n = train.agg(F.sum(label).alias("pos"), F.count(label).alias("n")).first()
    ratio = (n["n"] - n["pos"]) / max(n["pos"], 1) if weighted else 1.0
    rows = train.withColumn("_w", F.when(F.col(label) == 1, float(ratio)).otherwise(1.0))
    base = Boosting(loss="logistic", label=label, weight="_w", rounds=rounds, depth=depth, rate=0.05, growth="level", l2=1.0,
                    min_rows=1, min_hessian=1.0, rows=0.85, columns=0.9, id_cols=(id_col,))
    if not calibrate:
        return CalibratedRisk(base.fit(rows), [(1.0, 0.0)])
    folded = with_fold(materialize(rows), id_col, folds, stratify=label)
    model, held = replace(base, folds=folds).fit_held_out(folded)
    fits = [_sigmoid(held.where(F.col("fold") == i).select(F.col("margin").alias("_margin"), F.col("label").alias(label)), label)
            for i in range(folds)]
    return CalibratedRisk(model, [(float(f.coefficients[0]), float(f.intercept)) for f in fits])


def model_scorer(prepare: PipelineModel, regressor, risk: CalibratedRisk) -> Scorer:
    """Scorer backed by fitted models; the score is clipped to 0-10."""

    def score(df: DataFrame) -> DataFrame:
        kept = df.columns
        out = predicted(regressor, prepare.transform(df), "_raw_score")
        out = risk.transform(out.select(*kept, "features", "_raw_score"))
        return out.withColumn("score", clip("_raw_score", 0.0, 10.0)).select(*kept, "score", "probability")

    return score


# ------------------------------------------------------------------ segmentation
def segment_name(workload: Column, wellness: Column, score: Column) -> Column:
    """Rule name of a centroid; the first matching rule counts."""
    overloaded, healthy, disengaged, other = SEGMENTS
    return (F.when((workload > 55) & (score > 5), overloaded)
            .when((wellness > 65) & (score < 4), healthy)
            .when((workload < 45) & (wellness < 50), disengaged)
            .otherwise(other))


def segment(df: DataFrame, k: int = 4, restarts: int = 10, features=SEGMENT_FEATURES, seed: int = SEED) -> DataFrame:
    """Append ``cluster_id`` and ``employee_segment`` from k-means on standardised indices.

    Two clusters may get the same name, so the id is kept; ids follow the centres' order. The
    best of ``restarts`` runs by within-cluster cost is used; all restarts share their scans.
    """
    rows = numeric_statistics(df, features).collect()  # one row per feature
    prepare = fit_preprocessor(df, numeric=features, categorical=(), output="_cluster_features", stats=rows)
    scaled = [f"n_{c}" for c in features]
    ready = prepare.transform(df)
    best, _ = kmeans(ready.select(*scaled), scaled, k, restarts, seed)
    stats = {r["feature"]: (r["mean"], r["std"] or 1.0) for r in rows}
    schema = T.StructType([T.StructField("cluster_id", T.IntegerType())]
                          + [T.StructField(c, T.DoubleType()) for c in features])
    centers = [(i, *[float(v) * stats[c][1] + stats[c][0] for c, v in zip(features, center)])
               for i, center in enumerate(best)]
    named = df.sparkSession.createDataFrame(centers, schema).select(
        "cluster_id", segment_name(*[F.col(c) for c in features]).alias("employee_segment"))
    # k rows
    return ready.withColumn("cluster_id", nearest(scaled, best)).drop("_cluster_features", *scaled).join(
        F.broadcast(named), "cluster_id", "left").select(*df.columns, "cluster_id", "employee_segment")

