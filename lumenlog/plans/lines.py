"""Log lines made from the events table: the same events as plain text, JSON, access log and syslog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_level():
    """error is ERROR, purchase WARN, all else INFO."""
    return F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").otherwise("INFO")


def event_lines(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """source_file (the user's bucket), line_no (the event's id), raw. The table is one row group; its rows are dealt over all cores, as blocks of log files would be."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    e = e.repartition(spark.sparkContext.defaultParallelism, "event_id")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    text = F.format_string("user %d %s from 10.%d.%d.1", "user_id", "event_type", F.col("user_id") % 256, F.col("event_id") % 256)
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 404).otherwise(200)
    pri = F.when(F.col("event_type") == "error", 131).when(F.col("event_type") == "purchase", 132).otherwise(134)
    raw = {
        "plain": F.concat(stamp, F.lit(" ["), event_level(), F.lit("] "), text),
        "json": F.to_json(F.struct(stamp.alias("timestamp"), event_level().alias("level"), text.alias("message"), F.col("event_type").alias("service"), F.col("user_id").alias("user"))),
        "access": F.format_string('10.%d.%d.1 - - [%s +0000] "GET /api/users/%d/%s HTTP/1.1" %d 12 "-" "agent"', F.col("user_id") % 256, F.col("event_id") % 256, F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), "user_id", "event_type", status),
        "syslog": F.format_string("<%d>1 %sZ host%d app %d ID1 - %s", pri, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("user_id") % 10, "user_id", text),
    }[kind]
    return e.select(F.concat(F.lit("u"), F.col("user_id") % 10).alias("source_file"), F.col("event_id").alias("line_no"), raw.alias("raw"))
