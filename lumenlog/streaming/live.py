"""The live engine: the batch expressions over a file stream, routed sinks, and counts in windows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenlog.operators.detect import BUILTIN, Rule
from lumenlog.operators.parse import parse_lines
from lumenlog.operators.pipeline import filter_records, route, sanitize_records, standard


def stream_lines(spark: SparkSession, paths: Sequence[str] | str, files_per_trigger: int = 100, recursive: bool = True) -> DataFrame:
    """New files of all folders as source_file, line_no (0: numbers are known at rest only), raw. The checkpoint holds which files are done.
    A file stream takes one path, so each has a reader of its own."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", str(recursive).lower())
    return reduce(DataFrame.unionByName, [_stream_path(reader.text(p)) for p in ([paths] if isinstance(paths, str) else paths)])


def _stream_path(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("_metadata.file_path").alias("source_file"), F.lit(0).cast("long").alias("line_no"), F.col("value").alias("raw"))


def parsed_records(lines: DataFrame, fmt: str = "auto", custom: str | None = None, names: dict[str, str] | None = None, year: int | None = None, **filters) -> DataFrame:
    """Parsed and filtered records; each line by the first format that fits."""
    return filter_records(parse_lines(lines, fmt, year, custom, names, sticky=False), **filters)


def live_records(lines: DataFrame, fmt: str = "auto", rules: Sequence[Rule] = BUILTIN, custom: str | None = None, names: dict[str, str] | None = None, year: int | None = None, **filters) -> DataFrame:
    """Parsed, filtered, sanitized, standard records."""
    return standard(sanitize_records(parsed_records(lines, fmt, custom, names, year, **filters), rules))


def batch_name(checkpoint: str, number: int) -> str:
    """A name of a stream's micro-batch that is the same when it is run again, and another stream's isn't."""
    return f"{hashlib.sha256(checkpoint.encode()).hexdigest()[:8]}-{number}"


def start_routed(
    records: DataFrame, targets: Sequence[tuple[str, str]], default: str, checkpoint: str, once: bool = True, rules: Callable[[], Sequence[Rule]] | None = None
) -> StreamingQuery:
    """Writes JSON lines to the target of each record's level; once: all that is there, then stop. With rules, records are parsed ones, and
    each micro-batch is sanitized by what rules() gives at its time.

    Each micro-batch has a folder of its own in its targets, which it writes anew where it is run again; and, with rules, in the folder of counters beside the checkpoint,
    with what it counted of each source in the records that it holds anyway.
    """

    def write(batch: DataFrame, number: int) -> None:
        clean = (batch if rules is None else sanitize_records(batch, rules())).persist(StorageLevel.DISK_ONLY)
        routed = (clean if rules is None else standard(clean)).withColumn("target", route(targets, default))
        for target in sorted({default, *(t for _, t in targets)}):
            routed.filter(F.col("target") == target).select(F.col("json").alias("value")).write.mode("overwrite").text(f"{target}/batch={batch_name(checkpoint, number)}")
        if rules is not None:
            source_counts(clean).write.mode("overwrite").parquet(f"{checkpoint}/counters/batch={number}")
        clean.unpersist()

    writer = observed(records).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def observed(records: DataFrame) -> DataFrame:
    """Records that are counted as they pass, for the listener of a stream: lines, parsed lines, errors."""
    parsed = F.col("is_parseable") if "is_parseable" in records.columns else F.lit(True)
    return records.observe("records", F.count(F.lit(1)).alias("lines"), F.count_if(parsed).alias("parsed"), F.count_if(F.col("level").isin("ERROR", "WARN")).alias("errors"))


def source_counts(clean: DataFrame) -> DataFrame:
    """source, kind, n of sanitized records: lines, parsed, errors, fields, sanitized fields, and what was found, by kind as `found:kind`."""
    one = lambda name, value: F.struct(F.lit(name).alias("kind"), value.cast("long").alias("n"))
    sure = lambda c: F.when(c, 1).otherwise(0)
    fixed = F.array(one("lines", F.lit(1)), one("parsed", sure(F.col("is_parseable"))), one("errors", sure(F.col("level").isin("ERROR", "WARN"))), one("fields", F.col("total_fields")), one("sanitized", F.col("sanitized_fields")))
    found = F.transform("found", lambda d: F.struct(F.concat(F.lit("found:"), d["match"]["kind"]).alias("kind"), F.lit(1).cast("long").alias("n")))
    return clean.select("source", F.explode(F.concat(fixed, found)).alias("c")).groupBy("source", "c.kind").agg(F.sum("c.n").alias("n"))


def stream_counts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """source, kind, n over all micro-batches of a stream so far; kind error_rate is errors by lines."""
    rows = spark.read.parquet(f"{checkpoint}/counters").groupBy("source", "kind").agg(F.sum("n").cast("double").alias("n"))
    rate = rows.groupBy("source").agg((F.sum(F.when(F.col("kind") == "errors", F.col("n"))) / F.sum(F.when(F.col("kind") == "lines", F.col("n")))).alias("n"))
    return rows.unionByName(rate.select("source", F.lit("error_rate").alias("kind"), F.coalesce("n", F.lit(0.0)).alias("n")))


def grid_stream(records: DataFrame, seconds: int = 3600, late: str = "1 hour") -> DataFrame:
    """Counts and errors in windows of a fixed grid, with a watermark for late records."""
    return records.withWatermark("ts", late).groupBy("source", F.window("ts", f"{seconds} seconds")).agg(F.count("*").alias("n"), F.count_if(F.col("level").isin("ERROR", "WARN")).alias("errors")).select("source", F.col("window.start").alias("start"), "n", "errors")
