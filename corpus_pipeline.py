"""A corpus pipeline: drop toxic documents, exact and near copies, mask personal data, pack.

``run`` applies the stages to the documents table; between stages the rows are written
as Parquet to the shared folder and read again.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from strainwise.llm import exact_dedup, ngram_join, packing, pii, toxicity
from strainwise.llm.common import arrow_limits, stored, table
from strainwise.plans.bounds import outlive, scratch_scope

# More dropped rows than this are removed by a shuffled join instead of a broadcast one.
MOST_BROADCAST = 500_000
ROW = "_row_number"


def _numbered(docs: DataFrame) -> DataFrame:
    """Stored documents with a unique row number, as ids may be null or occur twice."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()))


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose numbers are in the stored ``dropped``."""
    side = F.broadcast(dropped) if dropped.count() <= MOST_BROADCAST else dropped
    return docs.join(side, ROW, "left_anti").drop(ROW)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    arrow_limits(spark)
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays."""
    arrow_limits(spark)
    rows = _numbered(docs)
    with scratch_scope(spark):  # the spill goes as soon as the decisions are stored
        found = exact_dedup.exact_dedup(rows, key_col=ROW)
        dropped = outlive(found.where("not kept").select(F.col("key").alias(ROW)))
    return _without(rows, dropped)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the row with the smallest id stays (null ids last)."""
    arrow_limits(spark)
    rows = _numbered(docs)
    with scratch_scope(spark):
        found = stored(ngram_join.ngram_classes(rows, id_col=ROW, unique_ids=True).select(ROW, "component_id"))
        # most documents are alone in their class: only the others are ranked
        shared = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id")
        crowded = stored(found.join(shared, "component_id").join(rows.select(ROW, "doc_id"), ROW))
        order = F.struct(F.col("doc_id").isNull(), "doc_id", ROW)
        first = crowded.groupBy("component_id").agg(F.min_by(ROW, order).alias("first"))
        dropped = outlive(crowded.join(first, "component_id").where(F.col(ROW) != F.col("first")).select(ROW))
    return _without(rows, dropped)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span becomes its kind in brackets; the stored length follows the new text."""
    arrow_limits(spark)
    masked = pii.mask_pii(docs)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        masked = masked.withColumn("n_chars", F.length("text").cast(kind))
    return masked.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: bin, slot, and the words of a piece."""
    arrow_limits(spark)
    return packing.best_fit_pack(packing.items_of(docs)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("pii", mask_personal_data),
    ("best_fit", pack),
]

# learned and iterative stages are beyond SQL; tests compare them with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
