"""Rosters that arrive file by file.

Medians, modes and scorer bounds come from the static master table; the stream
itself keeps no state except one row per group of the running reports.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.bands import hours_band
from ..functions.text import as_number
from ..operators.breakdown import UNKNOWN, breakdown, fleet_measures, group_measures
from ..operators.scoring import Scorer, score_roster
from ..schema import DEFAULT_THRESHOLD
from ..sources.headers import require_fields


def read_roster_stream(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "csv",
                       files_per_trigger: int = 100, pattern: str | None = None) -> DataFrame:
    """File stream with a declared schema; the required fields must be in it."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if fmt == "csv":
        # headers are checked against the declared names, file by file
        reader = reader.option("header", True).option("enforceSchema", False)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return require_fields(reader.load(folder))


def score_stream(stream: DataFrame, defaults: dict, scorer: Scorer,
                 threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Same projection as in batch."""
    return score_roster(stream, defaults, scorer, threshold)


def append_scored(scored: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Append every scored file once; restarts continue from the checkpoint."""
    return (scored.writeStream.format(fmt).outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def running_breakdown(scored: DataFrame, key: str, path: str, checkpoint: str,
                      threshold: float = DEFAULT_THRESHOLD) -> StreamingQuery:
    """Breakdown over everything seen so far, written below ``path`` after each batch.

    Every batch has a folder of its own, complete when its success marker is there;
    :func:`latest_breakdown` reads the newest complete one, so readers never see a gap.
    State is one row per key value, so no watermark is needed.
    """
    groups = breakdown(scored, key, limit=None, threshold=threshold)

    def publish(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch:012d}")

    return (groups.writeStream.outputMode("complete").foreachBatch(publish)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


REPORT_KEYS = {"roles": "job_role", "modes": "work_mode", "cities": "city"}


def running_reports(scored: DataFrame, path: str, checkpoint: str, threshold: float = DEFAULT_THRESHOLD,
                    keys: dict | None = None, state: str = "state", hours: str = "work_hours_per_week") -> StreamingQuery:
    """All running reports from one stateful query: each batch publishes them together or not at all.

    Reports: one per entry of ``keys`` (report name to column, NULL counts as Unknown),
    ``states`` (rows of no known state are left out), ``hours`` (per hours band) and
    ``fleet``, one row. Reports on columns that the stream lacks are left out; for states
    from cities apply ``with_state`` first. Each row enters once per report and is summed
    up per task before the shuffle, so the single fleet group is no hot key. State is one
    row per group. Results are read by :func:`latest_report`.
    """
    kinds = dict(scored.dtypes)
    named = {r: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) for r, c in (keys or REPORT_KEYS).items() if c in kinds}
    if state in kinds:
        place = F.col(state).cast("string")
        named["states"] = F.when(~place.isin("None", "nan"), place)
    if hours in kinds:
        named["hours"] = hours_band(as_number(hours) if kinds[hours] == "string" else F.col(hours))
    named["fleet"] = F.lit("")
    entries = F.array(*[F.struct(F.lit(r).alias("report"), name.alias("name")) for r, name in named.items()])
    rows = scored.select("score", "probability", F.explode(entries).alias("p")).where("p.name is not null")
    groups = rows.groupBy("p.report", "p.name").agg(
        F.struct(*group_measures("score", threshold)).alias("grouped"), F.struct(*fleet_measures(threshold)).alias("fleet"))

    def publish(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch:012d}")

    return (groups.writeStream.outputMode("complete").foreachBatch(publish)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_report(spark: SparkSession, path: str, report: str) -> DataFrame:
    """One report of the newest complete batch of :func:`running_reports`, with the columns of its batch form."""
    rows = latest_breakdown(spark, path).where(F.col("report") == report)
    return rows.select("fleet.*") if report == "fleet" else rows.select("name", "grouped.*")


def latest_breakdown(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete result of :func:`running_breakdown`, or all of :func:`running_reports`."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = sorted(str(s.getPath().getParent()) for s in files.globStatus(
        spark._jvm.org.apache.hadoop.fs.Path(f"{path}/epoch=*/_SUCCESS")))
    if not done:
        raise ValueError("no complete breakdown below " + path)
    return spark.read.option("basePath", done[-1]).parquet(done[-1])
