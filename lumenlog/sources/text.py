"""Sources: text files with exact line numbers, sanitized JSON lines, alerts and feedback; sinks for records and alerts."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlog.operators.detectors import ALERT
from lumenlog.sources.resume import Manifest, plan, read_ranges, wide_codec

#: How times of alerts are written, to the microsecond.
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def input_files(spark: SparkSession, paths: Sequence[str] | str, recursive: bool = True, glob: str | None = None) -> list[str]:
    """The files behind paths (files, folders, patterns), each once, in order; ValueError where there are none."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    try:
        files = sorted(set((reader.option("pathGlobFilter", glob) if glob else reader).text(paths).inputFiles()))
    except AnalysisException as e:
        raise ValueError(f"no input files found: {e}") from e
    if not files:
        raise ValueError("no input files found")
    return files


def read_lines(spark: SparkSession, paths: Sequence[str] | str, recursive: bool = True, glob: str | None = None, encoding: str = "utf-8", sizes: bool = False) -> DataFrame:
    """source_file, line_no (from 1), raw of all text files, and with sizes file_size. Files are split between tasks; a file's lines are numbered by block and order.

    Ids that grow with position give the order; counts of (file, task) give each task's first number, so no file is gathered in one task. Bytes that the
    encoding doesn't have become U+FFFD. UTF-16 and UTF-32, whose line ends are no bytes of ASCII, are read by ranges aligned to their code units.
    """
    if wide_codec(encoding).startswith(("utf-16", "utf-32")):
        lines, _ = read_ranges(spark, plan(input_files(spark, paths, recursive, glob), Manifest(), encoding, idle_seconds=0)[0])
        return lines if sizes else lines.drop("file_size")
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    lines = (reader.option("pathGlobFilter", glob) if glob else reader).text(paths)
    size = [F.col("_metadata.file_size").alias("file_size")] if sizes else []
    lines = lines.select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"), *size)
    firsts = lines.groupBy("source_file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).select("source_file", "block", "skip")
    return lines.join(firsts, ["source_file", "block"]).select("source_file", (F.col("at") + F.col("skip")).alias("line_no"), decoded(F.col("raw"), encoding).alias("raw"), *(["file_size"] if sizes else []))


def decoded(text: Column, encoding: str = "utf-8") -> Column:
    """Text whose bytes are of an encoding; native for UTF-8, else in Arrow batches."""
    if encoding.lower().replace("_", "-") in ("utf-8", "utf8"):
        return F.make_valid_utf8(text)

    def decode(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else x.decode(encoding, "replace") for x in column.to_pylist()], pa.string())

    return F.arrow_udf(decode, "string")(text.cast("binary"))


def read_log(spark: SparkSession, path: str, key: str, run: int) -> DataFrame | None:
    """The newest row of each key in what runs up to a number have written; None where there is none yet. Rows that say removed count as none."""
    try:
        rows = spark.read.json(path)
    except AnalysisException:
        return None
    if "run" not in rows.columns:
        return None
    rows = rows.filter(F.col("run") <= run)
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "run").alias("row")).select(key, "row.*")
    return (newest.filter("removed IS NULL OR NOT removed").drop("removed") if "removed" in rows.columns else newest).drop("run")


def write_log(rows: DataFrame, path: str, run: int) -> None:
    """Writes a run's rows for read_log, in a folder of its own; those of earlier runs stay."""
    rows.write.mode("overwrite").json(f"{path}/run={run}")


def read_sanitized(spark: SparkSession, path: str) -> DataFrame:
    """Records of written JSON lines, for replay in event time; lines that are no JSON are left out."""
    schema = "timestamp string, level string, source string, message string, extra map<string,string>, _bad string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", "true").json(path)
    return rows.filter("_bad IS NULL").select(F.col("timestamp").try_cast("timestamp").alias("ts"), F.coalesce("level", F.lit("UNKNOWN")).alias("level"), "source", "message", "extra")


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """alert_id, action, is_false_positive, at, and error for lines that are none; no rows where there is no file yet."""
    try:
        found = spark.read.text(path)
    except AnalysisException:
        found = spark.createDataFrame([], "value string")
    lines = found.filter("trim(value) <> ''").withColumn("at", F.monotonically_increasing_id())
    doc = F.from_json("value", "alert_id string, action string, is_false_positive boolean")
    return lines.withColumn("d", doc).select("d.alert_id", "d.action", "d.is_false_positive", "at", F.when(F.col("d.alert_id").isNull(), "no alert_id").alias("error"))


def write_records(standard: DataFrame, path: str, mode: str = "append", split: str | None = None) -> None:
    """JSON lines; split by day or hour writes into folders date=/hour=, records without a time into the default ones."""
    out = standard.select(F.col("json").alias("value"), "ts")
    if split:
        out = out.withColumn("date", F.date_format("ts", "yyyy-MM-dd"))
        keys = ["date"] + (["hour"] if split == "hour" else [])
        out = out.withColumn("hour", F.date_format("ts", "HH")) if split == "hour" else out
        out.drop("ts").write.mode(mode).partitionBy(*keys).text(path)
    else:
        out.select("value").write.mode(mode).text(path)


def write_alerts(alerts: DataFrame, path: str, batch: str | None = None) -> None:
    """Alerts as JSON lines, appended; those of a stream's batch, or of a numbered run, in a folder of its own, so that what is run again writes nothing twice."""
    alerts.write.mode("overwrite" if batch else "append").option("ignoreNullFields", "false").option("timestampFormat", STAMP).json(f"{path}/batch={batch}" if batch else path)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Written alerts of runs and streams."""
    return spark.read.option("recursiveFileLookup", "true").option("timestampFormat", STAMP.replace("SSSSSS", "[SSSSSS][SSS]")).schema(f"{ALERT}, alert_id string").json(path)
