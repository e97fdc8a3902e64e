"""Sinks: tables, roster export, metrics document, fitted pipelines."""

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import LIMITATIONS


# padding blanks are data: Spark would drop them on the way out
CSV = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_master(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Master table as parquet (default) or CSV with a header."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.options(**CSV).csv(path)
    else:
        writer.format(fmt).save(path)


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Filtered roster or importance table as CSV part files."""
    df.write.mode(mode).options(**CSV).csv(path)


def metrics_document(facts: DataFrame, comparison: DataFrame, features, threshold: float,
                     quantile: float, risk_metrics: DataFrame | None = None, excluded=()) -> DataFrame:
    """One row: dataset facts, the metrics per model, the chosen model, risk rule and metrics, limits.

    ``facts`` has one row (``rows``, ``labeled`` and, if known, ``test``), ``comparison``
    one row per model, ``risk_metrics`` one row of ``evaluate.classification_metrics``.
    """
    test = F.col("test") if "test" in facts.columns else F.lit(None).cast("bigint")
    measured = ("roc_auc", "pr_auc", "f1_at_0_5", "positive_rate")
    if risk_metrics is not None:
        risk = risk_metrics.select(F.struct(*measured).alias("s")).scalar()
        measures = [risk[c].alias(c) for c in measured]
    else:
        measures = [F.lit(None).cast("double").alias(c) for c in measured]
    models = F.array_sort(F.collect_list(F.struct("rmse", "model", "mae", "r2")))  # one entry per model
    line = comparison.agg(models.alias("models")).select(
        F.struct(
            F.col("models"),
            F.element_at("models", 1)["model"].alias("recommended_model"),
        ).alias("s")).scalar()
    return facts.select(
        F.struct(F.col("rows").alias("total_rows"), F.col("labeled").alias("labeled_rows"),
                 test.alias("test_rows"), F.array(*[F.lit(f) for f in features]).alias("features_used"),
                 F.array(*[F.lit(f) for f in excluded]).cast("array<string>").alias("features_excluded")).alias("dataset"),
        line["models"].alias("regression_models"),
        line["recommended_model"].alias("recommended_model"),
        F.struct(F.lit(threshold).alias("threshold"), F.lit(quantile).alias("risk_quantile"),
                 F.lit(f"score of at least the {quantile:g} quantile of the training rows").alias("definition"),
                 *measures).alias("risk_model"),
        F.array(*[F.lit(t) for t in LIMITATIONS]).alias("limitations"),
    )


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def read_master(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)
