"""File sources: layout CSVs, rosters, metrics JSON."""

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.numbers import nan_to_null
from ..schema import LAYOUT_FILES, RAW_TYPES
from .layouts import from_employees, from_ordinal, from_survey, from_tech, unify

# First lines of CSV files read at once.
HEADER_READERS = 32

LAYOUTS = {
    "tech": from_tech,
    "employees": from_employees,
    "survey": from_survey,
    "ordinal": from_ordinal,
}


def path_exists(spark: SparkSession, path: str) -> bool:
    """Ask the path's own file system (local, HDFS, object store)."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _first_line(spark: SparkSession, target, charset: str = "UTF-8") -> str:
    """First line of a file that is not blank, unpacked where its name says so."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    stream = target.getFileSystem(conf).open(target)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(target)
        plain = stream if codec is None else codec.createInputStream(stream)
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, charset))
        line = lines.readLine()
        while line is not None and not line.strip("\ufeff \t"):
            line = lines.readLine()
        return "" if line is None else line.removeprefix("\ufeff")
    finally:
        stream.close()


def csv_headers(spark: SparkSession, path: str, options: dict | None = None) -> dict:
    """Column names -> files below ``path`` that begin with them.

    First lines are read side by side through the path's file system, without a Spark job a
    file; Spark's reader then names the columns once per distinct line. A header whose quoted
    names hold line breaks is read from its file (``multiLine``).
    """
    options = {"escape": '"'} | (options or {})
    target = spark._jvm.org.apache.hadoop.fs.Path
    files = [target(spark._jvm.java.net.URI(f)) for f in sorted(spark.read.format("text").load(path).inputFiles())]
    by_line: dict[str, list] = {}
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        for line, file in zip(pool.map(lambda f: _first_line(spark, f), files), files):
            by_line.setdefault(line, []).append(file.toString())
    found: dict[tuple, list] = {}
    for line, same in by_line.items():
        # an open quote at the end of the line: the header goes on
        if line.count('"') % 2:
            for file in same:
                names = spark.read.options(**options).csv(file, header=True).columns
                found.setdefault(tuple(names), []).append(file)
        else:
            head = spark.sparkContext.parallelize([line] if line else [], 1)
            names = spark.read.options(**options).csv(head, header=True).columns if line else []
            found.setdefault(tuple(names), []).extend(same)
    return found


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             multi_line: bool = False) -> DataFrame:
    """CSV with a header, matched by name in every file; without a ``schema`` all columns are text.

    Files of a folder may order their columns differently: files with the same header are
    one scan, and the scans are united by name. A column that some files lack is NULL
    there; one that all of them lack is an error, like in any reader that accesses
    columns by name. With a schema surplus columns are dropped, and text that is no
    number reads as NULL. ``multi_line`` keeps line breaks inside quoted values together
    (files are then not split).
    """
    options = {"header": True, "multiLine": multi_line, "escape": '"', "enforceSchema": True, "mode": "PERMISSIVE"}
    headers = csv_headers(spark, path, {"multiLine": multi_line})
    if schema is not None:
        absent = sorted(set(schema.names) - {n for names in headers for n in names})
        if absent:
            raise ValueError("columns absent in " + path + ": " + ", ".join(absent))
    wanted = {f.name: f for f in schema or ()}
    scans = []
    for names, files in headers.items():
        if not names and len(headers) > 1:
            continue  # empty files
        full = T.StructType([wanted.get(n, T.StructField(n, T.StringType())) for n in names])
        df = spark.read.options(**options).schema(full).csv(files)
        scans.append(df if schema is None else df.select(*[f"`{n}`" for n in schema.names if n in names]))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)
    return out if schema is None else nan_to_null(out.select(*[f"`{n}`" for n in schema.names]))


def read_layout(spark: SparkSession, folder: str, layout: str) -> DataFrame | None:
    """One mapped source, or None when its file is not there."""
    path = f"{folder.rstrip('/')}/{LAYOUT_FILES[layout]}"
    if not path_exists(spark, path):
        return None
    return LAYOUTS[layout](read_csv(spark, path, RAW_TYPES[layout]))


def read_sources(spark: SparkSession, folder: str) -> DataFrame:
    """All layouts found in a folder as one canonical table."""
    return unify([read_layout(spark, folder, layout) for layout in LAYOUTS])


def read_threshold(spark: SparkSession, path: str) -> float:
    """Risk threshold from a metrics document."""
    doc = spark.read.json(path, multiLine=True)
    value = doc.select(F.col("risk_model.threshold").cast("double").alias("t")).first()
    if value is None or value["t"] is None:
        raise ValueError("no risk_model.threshold in " + path)
    return value["t"]


def read_roster(spark: SparkSession, path: str, max_rows: int | None = None,
                max_bytes: int | None = None) -> DataFrame:
    """An uploaded roster as text columns, after the upload guards.

    There is no size limit unless the caller states one.
    """
    if not path.lower().rstrip("/").endswith(".csv"):
        raise ValueError("Only CSV files are accepted.")
    if max_bytes is not None:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.getContentSummary(target).getLength() > max_bytes:
            raise ValueError(f"File exceeds {max_bytes} bytes.")
    df = read_csv(spark, path)
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"File exceeds {max_rows:,} rows.")
    if df.isEmpty():
        raise ValueError("Uploaded file has no employee rows.")
    return df
