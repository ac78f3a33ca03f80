"""The core engine's queries and their SQL, by name. Where they fix one of two readings, the docstrings of the operators say which."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog import catalog_cases, catalog_files
from lumenlog.functions import patterns as P
from lumenlog.functions import scalars as S
from lumenlog.operators import alerts as A
from lumenlog.operators import detectors as D
from lumenlog.operators import pipeline as L
from lumenlog.operators.anchored import spread_alerts
from lumenlog.operators.detect import BUILTIN, detections, sanitize
from lumenlog.operators.parse import parse_lines
from lumenlog.plans.lines import event_level, event_lines


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    return e.select("event_id", F.col("event_id").alias("line_no"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), F.col("user_id") % 10).alias("source"), event_level().alias("level"), F.format_string("user %d %s from 10.0.0.%d", "user_id", "event_type", F.col("user_id") % 256).alias("message"))


def _parsed(kind: str, fmt: str = "auto"):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return parse_lines(event_lines(spark, sf_dir, kind), fmt).select("line_no", "fmt", "level", "message", F.unix_seconds("ts").alias("epoch"), F.element_at("extra", {"access": "status", "syslog": "hostname", "json": "user"}.get(kind, "none")).alias("detail"))

    return query


def detect_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections in documents by source and kind."""
    hits = _documents(spark, sf_dir).select("source", F.explode_outer(detections(F.col("text"))).alias("m")).filter("m IS NOT NULL")
    return hits.groupBy("source", F.col("m.kind").alias("kind")).agg(F.count("*").alias("n"))


def sanitize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with addresses generalised."""
    rules = [r for r in BUILTIN if r.name in ("ipv4", "email")]
    return sanitize(_documents(spark, sf_dir), "text", rules).select("doc_id", F.sha2(F.col("sanitized").cast("binary"), 256).alias("sanitized_sha256"), F.size("found").cast("long").alias("n"))


def sanitize_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all built-in rules applied: digests and numbers of matches."""
    return sanitize(_documents(spark, sf_dir), "text").select("doc_id", F.sha2(F.col("sanitized").cast("binary"), 256).alias("sanitized_sha256"), F.size("found").cast("long").alias("n"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash and keyed hash of event properties, masked."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props")
    return e.select("event_id", S.sha256_hash(F.col("props")).alias("hash"), S.hmac_sha256(F.col("props"), "key").alias("hmac"), S.mask_value(F.col("props"), 2, 1).alias("masked"))


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luhn and identity-card checks of numbers made from event ids."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    card, ident = F.concat(F.lit("411111"), F.lpad(F.col("event_id").cast("string"), 10, "0")), F.concat(F.lit("11010119900101"), F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0"))
    return e.select("event_id", S.luhn_ok(card).alias("luhn"), S.id_card_ok(ident).alias("id_card"))


def _sanitized(spark: SparkSession, sf_dir: str, kind: str = "plain") -> DataFrame:
    return L.sanitize_records(parse_lines(event_lines(spark, sf_dir, kind)))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit statistics of each file."""
    return L.file_stats(_sanitized(spark, sf_dir)).select("source_file", "total_lines", "parsed_lines", "unparsed_lines", F.col("total_fields").cast("long").alias("total_fields"), F.col("sanitized_fields").cast("long").alias("sanitized_fields"), "bytes")


def report_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections by file and kind, with totals."""
    return L.detection_counts(_sanitized(spark, sf_dir))


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by level, time and keywords."""
    rows = parse_lines(event_lines(spark, sf_dir, "plain"), "plaintext")
    return L.filter_records(rows, levels=["ERROR", "WARNING"], start="2024-01-05 00:00:00", end="2024-01-20 00:00:00", include=["user 1", "user 2"], exclude=["purchase from"]).select("line_no", "level")


def standard_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sanitized standard JSON lines."""
    return L.standard(_sanitized(spark, sf_dir)).select("line_no", "json")


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by target, day and hour."""
    rows = parse_lines(event_lines(spark, sf_dir, "plain"), "plaintext")
    return rows.groupBy(L.route([("ERROR,CRITICAL", "errors"), ("WARN", "warnings")], "rest").alias("target"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.date_format("ts", "HH").alias("hour")).agg(F.count("*").alias("n"))


def previewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 records of each file, before and after."""
    return L.preview(_sanitized(spark, sf_dir))


def templated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of page urls."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url")
    return p.select(S.templatize(F.col("url")).alias("template")).groupBy("template").agg(F.count("*").alias("n"))


def patterns_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates that first come after 100 lines of a source."""
    return D.new_patterns(_events(spark, sf_dir), 100)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a day."""
    return D.grid_windows(_events(spark, sf_dir), 86400).select("source", F.col("w").cast("long").alias("w"), "n", "errors", F.round("rate", 9).alias("rate"))


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency spikes over windows of a day."""
    out = D.frequency_spikes(D.grid_windows(_events(spark, sf_dir), 86400), 86400, multiplier=1.2)
    return out.select("source", F.col("w").cast("long").alias("w"), F.round("frequency", 9).alias("frequency"), F.round("baseline", 9).alias("baseline"), "spike")


def surges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error-rate surges over windows of a day."""
    out = D.error_surges(D.grid_windows(_events(spark, sf_dir), 86400), 20, 1.5)
    return out.select("source", F.col("w").cast("long").alias("w"), F.round("z", 6).alias("z"), "surge")


_DAY = D.DetectorConfig(window_seconds=86400, multiplier=1.1, z_threshold=1.5, min_samples=50)


def anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors over anchored windows of a day, in event time."""
    return D.anchored_alerts(_events(spark, sf_dir), _DAY)


def anchored_micros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of all detectors in anchored windows, their times in microseconds."""
    return anchored(spark, sf_dir).withColumn("micros", F.unix_micros("ts")).drop("ts")


def anchored_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts of anchored_alerts, found with a source's records over all tasks."""
    return spread_alerts(_events(spark, sf_dir), _DAY).withColumn("micros", F.unix_micros("ts")).drop("ts")


def anchored_two_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors over sources whose lines lie in two files, each with line numbers of its own."""
    later = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    rows = _events(spark, sf_dir).withColumn("source_file", F.when(later, "b.log").otherwise("a.log")).withColumn("line_no", F.col("line_no") - F.when(later, 1_000_000_000).otherwise(0))
    return D.anchored_alerts(rows, _DAY).withColumn("micros", F.unix_micros("ts")).drop("ts")


def alert_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts deduplicated, correlated, suppressed and counted."""
    rules = [A.Suppression("night", "suppress", cron="* 0-5 * * *", alert_types=("new_pattern",)), A.Suppression("calm", "downgrade", severities=("WARNING",), source_pattern="^u[0-4]$")]
    kept = A.correlate(A.dedup(anchored(spark, sf_dir), 600), 86400)
    return A.alert_stats(A.release(A.apply_suppression(kept, rules)))


def cron(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that a cron predicate and a rule match."""
    return _events(spark, sf_dir).filter(S.cron_matches("*/15 8-17 * * 0-4", F.col("ts"))).groupBy("source", "level").agg(F.count("*").alias("n"))


QUERIES = {
    "detect_counts": detect_counts, "sanitize_documents": sanitize_documents, "sanitize_all": sanitize_all, "hashes": hashes, "checks": checks,
    "parse_plain": _parsed("plain"), "parse_json": _parsed("json"), "parse_access": _parsed("access"), "parse_syslog": _parsed("syslog"),
    "filtered": filtered, "standard_json": standard_json, "routed": routed, "report": report, "report_kinds": report_kinds, "previewed": previewed,
    "templates": templated, "new_patterns": patterns_new, "grid_windows": grid, "frequency_spikes": spikes, "error_surges": surges,
    "anchored_alerts": anchored_micros, "anchored_spread": anchored_spread, "anchored_two_files": anchored_two_files, "alert_pipeline": alert_pipeline, "cron": cron, **catalog_cases.QUERIES, **catalog_files.QUERIES,
}

flagship = detect_counts

_BASE = """e AS (SELECT event_id, event_id AS line_no, ts, user_id, event_type, 'u' || (user_id % 10) AS source,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END AS level,
  'user ' || user_id || ' ' || event_type || ' from 10.' || (user_id % 256) || '.' || (event_id % 256) || '.1' AS message FROM events)"""
_GRID = f"""WITH {_BASE}, g AS (SELECT source, (floor(epoch_us(ts) / 86400000000) * 86400)::BIGINT AS w, count(*) AS n,
  count(*) FILTER (level IN ('ERROR', 'WARN')) AS errors FROM e GROUP BY ALL)"""
# Windows open at a record and close with the first later one of the source that comes a day or more after; closing alerts tell the lines from the window's first to the one before.
_ANCHORED = f"""WITH RECURSIVE {_BASE}, r AS (SELECT source, line_no, epoch_us(ts) AS us, level, 'user <NUM> ' || event_type || ' from <IP>' AS template, row_number() OVER (PARTITION BY source ORDER BY line_no) AS nth FROM e),
opened AS (SELECT source, 1 AS k, nth, us FROM r WHERE nth = 1
  UNION ALL SELECT o.source, o.k + 1, min(r.nth), arg_min(r.us, r.nth) FROM opened o JOIN r ON r.source = o.source AND r.nth > o.nth AND r.us >= o.us + 86400000000 GROUP BY o.source, o.k),
b AS (SELECT source, k, nth AS low, coalesce(lead(nth) OVER s, 9000000000000000000) AS high, lead(us) OVER s AS closing FROM opened WINDOW s AS (PARTITION BY source ORDER BY k)),
w AS (SELECT b.source, k, low, high, coalesce(any_value(closing), arg_max(us, nth)) AS micros, min_by(line_no, nth) AS line_start, max_by(line_no, nth) AS line_end, count(*) AS n,
  count(*) FILTER (level IN ('ERROR', 'WARN')) / count(*) AS rate FROM b JOIN r ON r.source = b.source AND nth >= low AND nth < high GROUP BY b.source, k, low, high),
ew AS (SELECT source, k, n / 86400::DOUBLE AS f, NULL::DOUBLE AS before, n / 86400::DOUBLE AS after FROM w WHERE k = 1
  UNION ALL SELECT w.source, w.k, w.n / 86400::DOUBLE, ew.after, 0.3::DOUBLE * (w.n / 86400::DOUBLE) + (1 - 0.3::DOUBLE) * ew.after FROM ew JOIN w ON w.source = ew.source AND w.k = ew.k + 1),
past AS (SELECT source, k, list_sort(list(rate) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) AS p FROM w),
med AS (SELECT *, (p[len(p) // 2 + len(p) % 2] + p[len(p) // 2 + 1]) / 2 AS m FROM past WHERE len(p) > 0),
dev AS (SELECT *, list_sort(list_transform(p, lambda x: abs(x - m))) AS d FROM med),
mad AS (SELECT *, (d[len(d) // 2 + len(d) % 2] + d[len(d) // 2 + 1]) / 2 AS a FROM dev),
z AS (SELECT w.*, p[len(p) // 2 + 1] AS mid, CASE WHEN a > 0 THEN (rate - m) / (1.4826::DOUBLE * a) WHEN rate = m THEN 0 ELSE 'inf'::DOUBLE END AS z FROM mad JOIN w USING (source, k)),
firsts AS (SELECT source, template, min(nth) AS nth FROM r GROUP BY ALL),
here AS (SELECT w.source, k, f.template, max(r.nth) IS NOT NULL AS present FROM w JOIN firsts f ON f.source = w.source AND f.nth < high
  LEFT JOIN r ON r.source = w.source AND r.template = f.template AND r.nth >= low AND r.nth <= high GROUP BY ALL),
runs AS (SELECT *, count(*) FILTER (present) OVER (PARTITION BY source, template ORDER BY k) AS run FROM here),
gone AS (SELECT source, k, template, row_number() OVER (PARTITION BY source, template, run ORDER BY k) AS absent FROM runs WHERE NOT present)
SELECT micros, 'WARNING' AS severity, 'frequency_spike' AS alert_type, source, 'frequency' AS detector, f AS trigger_value, before * 1.1::DOUBLE AS threshold, before AS baseline_value, line_start, line_end, format('{{:.4f}} records a second', f) AS description
FROM ew JOIN w USING (source, k) WHERE f > before * 1.1::DOUBLE
UNION ALL SELECT micros, 'WARNING', 'error_rate_surge', source, 'error_rate', rate, 1.5, mid, line_start, line_end, format('error rate {{:.4f}}, z {{:.2f}}', rate, z) FROM z WHERE z > 1.5
UNION ALL SELECT r.us, 'WARNING', 'new_pattern', r.source, 'pattern', 1, 50, 0, w.line_start, r.line_no, 'new: ' || r.template FROM firsts JOIN r USING (source, template, nth) JOIN w ON w.source = r.source AND r.nth >= low AND r.nth < high WHERE r.nth > 50
UNION ALL SELECT micros, 'INFO', 'pattern_disappeared', w.source, 'pattern', 3, 3, (SELECT count(*) FROM r WHERE r.source = w.source AND r.template = g.template AND r.nth < w.high), line_start, line_end, 'not seen: ' || g.template
FROM gone g JOIN w ON w.source = g.source AND w.k = g.k WHERE absent % 3 = 0"""
_PARSED = "SELECT line_no, '{fmt}' AS fmt, {level} AS level, {message} AS message, epoch(date_trunc('second', ts))::BIGINT AS epoch, {detail} AS detail FROM e"
_LUHN = "list_sum(list_transform(range(len({v})), lambda i: CASE WHEN i % 2 = 0 THEN {v}[len({v}) - i]::INT ELSE CASE WHEN {v}[len({v}) - i]::INT > 4 THEN {v}[len({v}) - i]::INT * 2 - 9 ELSE {v}[len({v}) - i]::INT * 2 END END)) % 10 = 0"
_HEX = lambda pad: "".join(f"\\x{b ^ pad:02X}" for b in b"key".ljust(64, b"\0"))

SQL = {
    "detect_counts": f"""
WITH m AS (
  SELECT source, 'ipv4' AS kind, unnest(regexp_extract_all(text, '{P.IPV4}')) AS v FROM documents
  UNION ALL SELECT source, 'email', unnest(regexp_extract_all(text, '{P.EMAIL}')) FROM documents
  UNION ALL SELECT source, 'bank_card', unnest(regexp_extract_all(text, '{P.BANK_CARD}')) FROM documents
  UNION ALL SELECT source, 'token', unnest(regexp_extract_all(text, '(?i){P.TOKEN.replace("'", "''")}', 1)) FROM documents)
SELECT source, kind, count(*) AS n FROM m WHERE kind <> 'bank_card' OR ({_LUHN.format(v="v")} AND v <> repeat('0', len(v))) GROUP BY ALL""",
    "sanitize_documents": rf"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '\b[A-Za-z0-9._%+-]+(@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}})\b', '***\1', 'g'),
  '\b((?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?))\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b', '\1.*.*', 'g')) AS sanitized_sha256,
  (len(regexp_extract_all(text, '{P.IPV4}')) + len(regexp_extract_all(text, '{P.EMAIL}')))::BIGINT AS n FROM documents""",
    "hashes": rf"""SELECT event_id, substr(sha256(props), 1, 16) AS hash,
  sha256('{_HEX(0x5C)}'::BLOB || unhex(sha256('{_HEX(0x36)}'::BLOB || encode(props)))) AS hmac,
  CASE WHEN len(props) <= 3 THEN repeat('*', len(props)) ELSE substr(props, 1, 2) || repeat('*', len(props) - 3) || right(props, 1) END AS masked FROM events""",
    "checks": f"""
WITH v AS (SELECT event_id, '411111' || lpad(event_id::VARCHAR, 10, '0') AS c, '11010119900101' || lpad((event_id % 10000)::VARCHAR, 4, '0') AS i FROM events)
SELECT event_id, {_LUHN.format(v="c")} AS luhn,
  (['1','0','X','9','8','7','6','5','4','3','2'])[list_sum(list_transform(range(1, 18), lambda k: substr(i, k, 1)::INT * ([7,9,10,5,8,4,2,1,6,3,7,9,10,5,8,4,2])[k]))::INT % 11 + 1] = substr(i, 18, 1) AS id_card FROM v""",
    "parse_plain": f"WITH {_BASE} " + _PARSED.format(fmt="plaintext", level="level", message="message", detail="NULL::VARCHAR"),
    "parse_json": f"WITH {_BASE} " + _PARSED.format(fmt="json", level="level", message="message", detail="user_id::VARCHAR"),
    "parse_access": f"WITH {_BASE} " + _PARSED.format(fmt="apache", level="CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END", message="'GET /api/users/' || user_id || '/' || event_type || ' HTTP/1.1'", detail="CASE event_type WHEN 'error' THEN '500' WHEN 'signup' THEN '404' ELSE '200' END"),
    "parse_syslog": f"WITH {_BASE} " + _PARSED.format(fmt="syslog", level="CASE event_type WHEN 'error' THEN 'WARN' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END", message="message", detail="'host' || (user_id % 10)"),
    "filtered": f"""WITH {_BASE} SELECT line_no, level FROM e WHERE level IN ('ERROR', 'WARN') AND date_trunc('second', ts) BETWEEN '2024-01-05' AND '2024-01-20'
  AND (contains(message, 'user 1') OR contains(message, 'user 2')) AND NOT contains(message, 'purchase from')""",
    "standard_json": rf"""WITH {_BASE} SELECT line_no, '{{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00","level":"' || level || '","source":"' || source || '","message":"'
  || regexp_replace(message, '10\.(\d+)\.\d+\.1$', '10.\1.*.*') || '","extra":{{}}}}' AS json FROM e""",
    "routed": f"""WITH {_BASE} SELECT CASE level WHEN 'ERROR' THEN 'errors' WHEN 'WARN' THEN 'warnings' ELSE 'rest' END AS target,
  strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour, count(*) AS n FROM e GROUP BY ALL""",
    "report": f"""WITH {_BASE} SELECT source AS source_file, count(*) AS total_lines, count(*) AS parsed_lines, 0::BIGINT AS unparsed_lines, count(*)::BIGINT AS total_fields,
  count(*)::BIGINT AS sanitized_fields, sum(19 + 2 + len(level) + 2 + len(message) + 1)::BIGINT AS bytes FROM e GROUP BY source""",
    "report_kinds": f"WITH {_BASE} SELECT source AS source_file, 'ipv4' AS kind, count(*) AS n FROM e GROUP BY source UNION ALL SELECT NULL, 'ipv4', count(*) FROM e UNION ALL SELECT NULL, NULL, count(*) FROM e",
    "previewed": rf"""WITH {_BASE} SELECT source AS source_file, line_no, message AS original_message, regexp_replace(message, '10\.(\d+)\.\d+\.1$', '10.\1.*.*') AS message
  FROM e QUALIFY row_number() OVER (PARTITION BY source ORDER BY line_no) <= 20""",
    "templates": r"""WITH t AS (SELECT regexp_replace(url, '/\d+$', '/<VAR>') AS u FROM pages), v AS (SELECT regexp_replace(u, '/\d+/', '/<VAR>/', 'g') AS u FROM t)
SELECT regexp_replace(u, '\b\d+\b', '<NUM>', 'g') AS template, count(*) AS n FROM v GROUP BY ALL""",
    "anchored_alerts": _ANCHORED,
    "anchored_spread": _ANCHORED,
    "anchored_two_files": _ANCHORED.replace("ORDER BY line_no) AS nth", "ORDER BY later, line_no) AS nth").replace("event_id AS line_no, ts", "event_id - CASE WHEN ts >= '2024-01-16' THEN 1000000000 ELSE 0 END AS line_no, ts >= '2024-01-16' AS later, ts"),
    "alert_pipeline": f"""{_ANCHORED.replace(")\nSELECT micros, 'WARNING' AS severity", "),\nfound AS (SELECT micros, 'WARNING' AS severity", 1)}),
d AS (SELECT DISTINCT source, alert_type, micros FROM found),
kept AS (SELECT source, alert_type, min(micros) AS micros FROM d GROUP BY ALL
  UNION ALL SELECT k.source, k.alert_type, n.micros FROM kept k, LATERAL (SELECT min(d.micros) AS micros FROM d WHERE d.source = k.source AND d.alert_type = k.alert_type AND d.micros >= k.micros + 600000000) n WHERE n.micros IS NOT NULL),
one AS (SELECT f.* FROM found f JOIN kept USING (source, alert_type, micros) QUALIFY row_number() OVER (PARTITION BY source, alert_type, micros ORDER BY trigger_value, description) = 1),
o AS (SELECT source, (alert_type = 'error_rate_surge')::INT AS kind, micros AS us, row_number() OVER (PARTITION BY source ORDER BY micros, alert_type = 'error_rate_surge') AS n FROM one WHERE alert_type IN ('frequency_spike', 'error_rate_surge')),
{catalog_cases.fold_sql("o", 86400)},
c AS (SELECT source, 'composite_anomaly' AS alert_type, 'CRITICAL' AS severity, 'frequency' AS detector, greatest(spike, surge) AS micros FROM pairs
  UNION ALL SELECT source, alert_type, severity, detector, micros FROM one WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.source = one.source AND one.micros = CASE one.alert_type WHEN 'frequency_spike' THEN p.spike WHEN 'error_rate_surge' THEN p.surge END)),
judged AS (SELECT source, alert_type, detector, CASE WHEN severity = 'WARNING' AND source <= 'u4' AND NOT (alert_type = 'new_pattern' AND hour(make_timestamp(micros)) <= 5) THEN 'INFO' ELSE severity END AS severity FROM c
  WHERE NOT (alert_type = 'new_pattern' AND hour(make_timestamp(micros)) <= 5))
SELECT 'total' AS dimension, 'all' AS value, count(*) AS n FROM judged UNION ALL SELECT 'severity', severity, count(*) FROM judged GROUP BY severity UNION ALL SELECT 'alert_type', alert_type, count(*) FROM judged GROUP BY alert_type
UNION ALL SELECT 'source', source, count(*) FROM judged GROUP BY source UNION ALL SELECT 'detector', detector, count(*) FROM judged GROUP BY detector""",
    "new_patterns": f"""WITH {_BASE}, t AS (SELECT source, line_no, 'user <NUM> ' || event_type || ' from <IP>' AS template, row_number() OVER (PARTITION BY source ORDER BY line_no) AS nth FROM e)
SELECT source, template, min(line_no) AS line_no FROM t GROUP BY source, template HAVING min(nth) > 100""",
    "grid_windows": _GRID + " SELECT source, w, n, errors, round(errors / n, 9) AS rate FROM g",
    "frequency_spikes": _GRID.replace("WITH e", "WITH RECURSIVE e", 1) + """, r AS (SELECT *, n / 86400.0::DOUBLE AS f, row_number() OVER (PARTITION BY source ORDER BY w) AS k FROM g),
x AS (SELECT source, w, k, f, NULL::DOUBLE AS b, f AS ew FROM r WHERE k = 1 UNION ALL SELECT r.source, r.w, r.k, r.f, x.ew, 0.3::DOUBLE * r.f + 0.7::DOUBLE * x.ew FROM x JOIN r ON r.source = x.source AND r.k = x.k + 1)
SELECT source, w, round(f, 9) AS frequency, round(b, 9) AS baseline, coalesce(f > b * 1.2::DOUBLE, false) AS spike FROM x""",
    "error_surges": _GRID + """, r AS (SELECT source, w, errors / n AS rate, list(errors / n) OVER (PARTITION BY source ORDER BY w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS past FROM g),
m AS (SELECT *, list_median(past) AS med FROM r), d AS (SELECT *, list_median(list_transform(past, lambda v: abs(v - med))) AS mad FROM m),
z AS (SELECT source, w, CASE WHEN coalesce(len(past), 0) = 0 THEN NULL WHEN mad = 0 AND rate = med THEN 0 WHEN mad = 0 THEN 'inf'::DOUBLE ELSE (rate - med) / (1.4826::DOUBLE * mad) END AS z FROM d)
SELECT source, w, round(CASE WHEN isfinite(z) THEN z END, 6) AS z, coalesce(z > 1.5, false) AS surge FROM z""",
    "cron": f"""WITH {_BASE} SELECT source, level, count(*) AS n FROM e WHERE minute(ts) % 15 = 0 AND hour(ts) BETWEEN 8 AND 17 AND isodow(ts) <= 5 GROUP BY ALL""",
    **catalog_cases.SQL,
    **catalog_files.SQL,
    "streamed_alerts": f"SELECT * FROM ({_ANCHORED.replace('ORDER BY line_no) AS nth', 'ORDER BY ts, line_no) AS nth').replace('coalesce(any_value(closing), arg_max(us, nth)) AS micros', 'any_value(closing) AS micros')}) WHERE micros IS NOT NULL",
}
