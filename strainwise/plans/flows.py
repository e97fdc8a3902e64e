"""The three end-to-end flows: build the master table, train, analyse a roster.

Each flow writes what later steps read again, so that no expensive step runs twice.
"""

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import bands, indices
from ..operators import breakdown as bd, clean, evaluate, models, policy, roster as ro, sampling, scoring, validate
from ..operators.align import align
from ..operators.explore import quantile_threshold
from ..schema import RISK_QUANTILE, TARGET
from ..sources import headers, sinks
from ..sources.readers import read_sources
from .bounds import materialize


def build_master(spark: SparkSession, folder: str, out: str, segments: bool = True, restarts: int = 10,
                 scale: float = 100.0) -> DataFrame:
    """Raw layouts -> canonical -> cleaned -> indices -> segments -> table at ``out``."""
    canonical = materialize(read_sources(spark, folder))
    master = indices.with_indices(clean.preprocess(canonical), scale)
    if segments:
        master = models.segment(materialize(master), restarts=restarts)
    sinks.write_master(master, out)
    return sinks.read_master(spark, out)


@dataclass
class Trained:
    prepare: PipelineModel
    regressor: object
    risk: models.CalibratedRisk
    threshold: float
    best: str
    comparison: DataFrame
    risk_metrics: DataFrame
    importance: list = field(default_factory=list)

    def scorer(self) -> scoring.Scorer:
        return models.model_scorer(self.prepare, self.regressor, self.risk)


def train(master: DataFrame, out: str | None = None, features=None, stratify: str | None = None, id_col: str = "employee_id",
          max_categories: int | None = None, quantile: float = RISK_QUANTILE, risk_rounds: int = 350,
          risk_depth: int = 6, folds: int = 3, **sizes) -> Trained:
    """Compare the regressors on a hold-out, keep the best, fit the calibrated risk model.

    ``features`` defaults to the deployment list without personal and health columns.
    ``sizes`` are the settings of :func:`models.regressors`. With ``out``, models,
    importances and the metrics document are written below it.
    """
    rows = sampling.with_split(validate.labeled(master), id_col, stratify=stratify)
    names = list(features or validate.model_columns(master.columns, pipeline=True))
    train_rows = rows.where("split = 'train'")
    numeric, categorical = validate.by_type(rows, names)
    prepare = models.fit_preprocessor(train_rows, numeric, categorical, max_categories)
    threshold = quantile_threshold(train_rows, quantile=quantile).first()["threshold"]
    # vectors are written once: every estimator reads them again
    ready = prepare.transform(rows).select(id_col, TARGET, "split", "features", bands.elevated(TARGET, threshold).alias("label"))
    slots = models.feature_names(ready)
    stored = materialize(ready)
    fit_rows, test_rows = stored.where("split = 'train'"), stored.where("split = 'test'")
    metrics, fitted = models.compare(fit_rows, test_rows, models.regressors(fit_rows, **sizes))
    comparison = materialize(metrics)  # one row per model
    best = models.best_model(comparison).first()["model"]
    risk = models.fit_risk(fit_rows, "label", id_col, folds, risk_rounds, risk_depth)
    risk_metrics = materialize(evaluate.classification_metrics(risk.transform(test_rows)))  # one row
    forest = fitted["gradient_boosting_sampled"]
    result = Trained(prepare, fitted[best], risk, threshold, best, comparison, risk_metrics,
                     models.importances(forest, slots))
    if out:
        facts = master.agg(F.count(F.lit(1)).alias("rows"), F.count(TARGET).alias("labeled")).withColumn(
            "test", F.lit(test_rows.count()))
        excluded = sorted(set(master.columns) - set(names))
        sinks.write_json(sinks.metrics_document(facts, comparison, names, threshold, quantile, risk_metrics, excluded),
                         f"{out}/metrics")
        table = master.sparkSession.createDataFrame(result.importance, "feature string, gain_importance double")
        sinks.export_csv(table.coalesce(1), f"{out}/feature_importance")
        sinks.save_model(prepare, f"{out}/prepare")
        models.save_regressor(result.regressor, f"{out}/score_model")
        risk.save(f"{out}/risk_model")
    return result


def analyse_roster(upload: DataFrame, defaults: dict, scorer: scoring.Scorer, threshold: float,
                   cleaned: bool = False) -> dict:
    """Everything an organisation asks of a roster, as named DataFrames.

    The roster is parsed, filled and scored once and written; every report reads that table.
    ``cleaned`` applies the category cleaning first; otherwise names stay as given.
    """
    df = headers.resolve_aliases(headers.require_fields(headers.normalize_headers(upload)))
    if cleaned:
        df = clean.clean_categories(df)
    # the upload as given, its filled features and its scores, side by side: read once
    boxed = df.withColumn("given", F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    whole = materialize(scoring.score_features(align(boxed, defaults, keep=["given"]), scorer, threshold))
    scored = bd.with_state(
        whole.select("given.*", "score", "probability", "band"),
        state="state" if "state" in df.columns else None, city="city" if "city" in df.columns else None)
    # the drivers and the what-if look at filled features
    filled = whole.drop("given", "score", "probability", "band")
    drivers = policy.role_drivers(whole.drop("given"))
    roles = bd.breakdown(scored, "job_role", threshold=threshold)
    out = {
        "coverage": headers.coverage(df),
        "summary": bd.fleet_summary(scored, threshold),
        "bands": bd.band_distribution(scored, threshold),
        "roles": policy.role_report(roles, drivers),
        "drivers": drivers,
        "policies": policy.policy_whatif(filled, scorer, threshold=threshold),
        "modes": bd.breakdown(scored, "work_mode", threshold=threshold),
        "hours": bd.breakdown_hours(scored, threshold=threshold),
        "table": ro.roster_table(scored),
    }
    if "city" in df.columns:
        out["cities"] = bd.breakdown(scored, "city", threshold=threshold)
    if {"city", "state"} & set(df.columns):
        out["states"] = bd.breakdown_state(scored, threshold=threshold)
    if "gender" in df.columns:
        out["genders"] = bd.breakdown(scored, "gender", threshold=threshold)
    return out
