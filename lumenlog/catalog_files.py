"""Queries that write the events as files and read them back: sources, sinks, streams, and tables of names; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.functions import scalars as S
from lumenlog.operators import alerts as A
from lumenlog.operators import pipeline as L
from lumenlog.operators.detect import BUILTIN, configured, sanitize
from lumenlog.operators.detectors import DetectorConfig
from lumenlog.operators.parse import parse_lines
from lumenlog.plans.lines import event_lines
from lumenlog.sources.text import read_alerts, read_feedback, read_lines, read_sanitized, write_alerts, write_records
from lumenlog.storage import settle, shared_dir
from lumenlog.streaming.keyed import keyed_alerts
from lumenlog.streaming.live import parsed_records, start_routed, stream_counts, stream_lines

DAY = DetectorConfig(window_seconds=86400, multiplier=1.1, z_threshold=1.5, min_samples=50)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lumenlog/{name}-{uuid.uuid4().hex}"


def _written(spark: SparkSession, sf_dir: str, kind: str = "plain") -> str:
    """A folder with a file of lines for each user bucket, in the order of events."""
    path = _folder(spark, "lines")
    lines = event_lines(spark, sf_dir, kind).repartition("source_file").sortWithinPartitions("source_file", "line_no")
    lines.select("source_file", F.col("raw").alias("value")).write.partitionBy("source_file").text(path)
    return path


def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of files with their numbers."""
    rows = read_lines(spark, _written(spark, sf_dir))
    return rows.select(F.regexp_extract("source_file", "source_file=(u\\d)", 1).alias("file"), "line_no", "raw")


def split_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written in folders by day and hour and read back: how many there are in each, and their levels."""
    path = _folder(spark, "out")
    write_records(L.standard(L.sanitize_records(parse_lines(event_lines(spark, sf_dir, "plain"), "plaintext"))), path, split="hour")
    rows = spark.read.option("basePath", path).schema("value string, date string, hour string").text(path)
    return rows.groupBy("date", "hour", F.get_json_object("value", "$.level").alias("level")).agg(F.count("*").alias("n"), F.count_if(F.col("value").contains(".*.*")).alias("masked"))


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written records read for replay."""
    path = _folder(spark, "out")
    write_records(L.standard(parse_lines(event_lines(spark, sf_dir, "json"), "json")), path)
    rows = read_sanitized(spark, path)
    return rows.groupBy("source", "level").agg(F.count("*").alias("n"), F.sum(F.unix_seconds("ts")).alias("total"), F.min("message").alias("first_message"), F.count(F.element_at("extra", "user")).alias("users"))


def overridden_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built-in rules with other strategies and parameters, and one turned off."""
    rules = configured({"ipv4": {"strategy": "hash", "params": {"hash_length": 12}}, "email": {"enabled": False}, "phone": {"params": {"keep_start": 1, "mask_char": "#"}}})
    text = "concat('at 10.0.', user_id % 256, '.', event_id % 256, ' u', user_id, '@ex.com call 138', lpad(CAST(event_id AS STRING), 8, '0')) AS text"
    return sanitize(spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", text), "text", rules).select("event_id", "sanitized")


def id_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers like phones in fields whose names look like an identifier's, and in others."""
    made = "CASE user_id % 5 WHEN 0 THEN 'order_id' WHEN 1 THEN 'phone' WHEN 2 THEN 'SerialNumber' WHEN 3 THEN event_type ELSE 'note' END AS field"
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", made)
    return rows.select("event_id", "field", S.is_id_field(F.col("field")).alias("is_id"))


def top_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields in which most is found."""
    made = "concat('{\"message\":\"from 10.0.0.1\",\"mail\":\"u@ex.com\"', CASE WHEN event_type = 'error' THEN ',\"peer\":\"10.1.1.1\"' ELSE '' END, CASE WHEN event_type = 'purchase' THEN ',\"o\":{\"list\":[\"a@b.cd\",\"e@f.gh\"]}' ELSE '' END, '}') AS raw"
    lines = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("'f' AS source_file", "event_id AS line_no", made)
    return L.top_fields(L.sanitize_records(parse_lines(lines, "json")))


def feedback_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback lines of a file, good and bad ones."""
    path = _folder(spark, "feedback")
    made = "CASE WHEN event_id % 9 = 0 THEN 'no json' WHEN event_id % 9 = 1 THEN '{\"action\":\"resolve\"}' ELSE concat('{\"alert_id\":\"a', user_id % 7, '\",\"action\":\"', CASE event_type WHEN 'error' THEN 'reopen' ELSE 'acknowledge' END, '\",\"is_false_positive\":', CAST(event_id % 2 = 0 AS STRING), '}') END AS value"
    spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(made).write.text(path)
    return read_feedback(spark, path).groupBy("alert_id", "action", "is_false_positive", "error").agg(F.count("*").alias("n"))


def alerts_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts written, read and listed by source."""
    fixed = "'WARNING' AS severity, 'new_pattern' AS alert_type, concat('u',user_id % 10) AS source, 'pattern' AS detector, 1.5D AS trigger_value, 1D AS threshold, 0D AS baseline_value, event_id AS line_start, event_id + 1 AS line_end, event_type AS description"
    path = _folder(spark, "alerts")
    write_alerts(A.with_ids(spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("CAST(ts AS timestamp) AS ts", *fixed.split(", "))), path, "0")
    return A.listing(read_alerts(spark, path), source_pattern="^u[1-3]$").select("source", F.unix_micros("ts").alias("micros"), "line_start", "line_end", "description", "trigger_value")


def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream over files counts of each source."""
    path, checkpoint = _written(spark, sf_dir, "json"), _folder(spark, "checkpoint")
    records = parsed_records(stream_lines(spark, path, files_per_trigger=1000), "json")
    start_routed(records, (), _folder(spark, "out"), checkpoint, rules=lambda: BUILTIN).awaitTermination()
    return stream_counts(spark, checkpoint).select("source", "kind", F.round("n", 9).alias("n"))


def streamed_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of a stream over the events, taken by time; each source's last window stays open."""
    path, found = _folder(spark, "records"), _folder(spark, "alerts")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("concat('u', user_id % 10) AS source", "CAST(ts AS timestamp) AS ts", "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END AS level", "concat('user ', user_id, ' ', event_type, ' from 10.0.0.', user_id % 256) AS message", "event_id AS line_no")
    rows.write.parquet(path)
    stream = keyed_alerts(spark.readStream.schema(rows.schema).parquet(path), DAY, timed=False)
    stream.writeStream.format("parquet").option("path", found).option("checkpointLocation", _folder(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return settle(spark.read.schema(stream.schema).parquet(found).withColumn("micros", F.unix_micros("ts")).drop("ts"), "streamed")


QUERIES = {
    "file_lines": file_lines, "split_output": split_output, "replayed": replayed, "overridden_rules": overridden_rules, "id_fields": id_fields, "top_fields": top_fields,
    "feedback_read": feedback_read, "alerts_listed": alerts_listed, "streamed_counts": streamed_counts, "streamed_alerts": streamed_alerts,
}

_E = """e AS (SELECT event_id, ts, user_id, event_type, 'u' || (user_id % 10) AS source, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END AS level,
  'user ' || user_id || ' ' || event_type || ' from 10.' || (user_id % 256) || '.' || (event_id % 256) || '.1' AS message FROM events)"""

SQL = {
    "file_lines": f"""WITH {_E} SELECT source AS file, row_number() OVER (PARTITION BY source ORDER BY event_id) AS line_no, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' [' || level || '] ' || message AS raw FROM e""",
    "split_output": f"""WITH {_E} SELECT strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour, level, count(*) AS n, count(*) AS masked FROM e GROUP BY ALL""",
    "replayed": f"""WITH {_E} SELECT event_type AS source, level, count(*) AS n, sum(floor(epoch(ts)))::BIGINT AS total, min(message) AS first_message, count(*) AS users FROM e GROUP BY ALL""",
    "overridden_rules": """SELECT event_id, 'at ' || substr(sha256('10.0.' || (user_id % 256) || '.' || (event_id % 256)), 1, 12) || ' u' || user_id || '@ex.com call 1######' || right(lpad(event_id::VARCHAR, 8, '0'), 4) AS sanitized FROM events""",
    "id_fields": """WITH f AS (SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'order_id' WHEN 1 THEN 'phone' WHEN 2 THEN 'SerialNumber' WHEN 3 THEN event_type ELSE 'note' END AS field FROM events)
SELECT event_id, field, contains(lower(field), 'id') OR contains(lower(field), 'seq') OR contains(lower(field), 'no') OR contains(lower(field), 'number') OR contains(lower(field), 'serial') AS is_id FROM f""",
    "top_fields": """WITH c AS (SELECT count(*) AS a, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'purchase') AS p FROM events),
f AS (SELECT unnest(['message', 'extra.mail', 'extra.peer', 'extra.o.list[0]', 'extra.o.list[1]']) AS field, unnest([a, a, e, p, p]) AS n FROM c) SELECT field, n FROM f WHERE n > 0""",
    "feedback_read": """WITH v AS (SELECT event_id % 9 AS k, CASE WHEN event_id % 9 > 1 THEN 'a' || (user_id % 7) END AS alert_id, CASE WHEN event_id % 9 = 1 THEN 'resolve' WHEN event_id % 9 > 1 THEN CASE event_type WHEN 'error' THEN 'reopen' ELSE 'acknowledge' END END AS action,
  CASE WHEN event_id % 9 > 1 THEN event_id % 2 = 0 END AS is_false_positive FROM events)
SELECT alert_id, action, is_false_positive, CASE WHEN alert_id IS NULL THEN 'no alert_id' END AS error, count(*) AS n FROM v GROUP BY ALL""",
    "alerts_listed": """SELECT 'u' || (user_id % 10) AS source, epoch_us(ts) AS micros, event_id AS line_start, event_id + 1 AS line_end, event_type AS description, 1.5::DOUBLE AS trigger_value FROM events WHERE user_id % 10 BETWEEN 1 AND 3""",
    "streamed_counts": f"""WITH {_E}, c AS (SELECT event_type AS source, count(*) AS n, count(*) FILTER (level IN ('ERROR', 'WARN')) AS errors FROM e GROUP BY ALL)
SELECT source, unnest(['lines', 'parsed', 'errors', 'fields', 'sanitized', 'found:ipv4', 'error_rate']) AS kind, unnest([n::DOUBLE, n::DOUBLE, errors::DOUBLE, n::DOUBLE, n::DOUBLE, n::DOUBLE, round(errors::DOUBLE / n, 9)]) AS n FROM c""",
}
