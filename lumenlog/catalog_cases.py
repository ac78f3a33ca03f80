"""Queries over made-up lines and alerts, one case for each event, that reach what the tables themselves don't hold; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.functions import scalars as S
from lumenlog.operators import alerts as A
from lumenlog.operators import detectors as D
from lumenlog.operators import nested as N
from lumenlog.operators import pipeline as L
from lumenlog.operators.detect import custom_rule, sanitize
from lumenlog.operators.mapping import MappingStore, mapped_records
from lumenlog.operators.parse import parse_lines
from lumenlog.storage import settle, shared_dir

# The texts are SQL that Spark and DuckDB read alike.
_KIND_TEXT = """CASE event_id % 11
  WHEN 0 THEN concat('addr 2001:db8:0:0:0:0:0:', CAST(event_id % 10000 AS STRING))
  WHEN 1 THEN concat('call 138', lpad(CAST(event_id AS STRING), 8, '0'), ' now')
  WHEN 2 THEN concat('id 11010119900101', lpad(CAST(event_id % 10000 AS STRING), 4, '0'))
  WHEN 3 THEN concat('x PHPSESSID=abc', CAST(event_id AS STRING), '&y')
  WHEN 4 THEN concat('Set-Cookie: sid=', CAST(event_id AS STRING), '; path=/')
  WHEN 5 THEN concat('password: pass api_key="k', CAST(event_id AS STRING), '"')
  WHEN 6 THEN concat('mail u', CAST(event_id AS STRING), '@10.0.0.1.example.com')
  WHEN 7 THEN concat('card 411111', lpad(CAST(event_id AS STRING), 10, '0'))
  WHEN 8 THEN concat('token=138', lpad(CAST(event_id AS STRING), 8, '0'))
  WHEN 9 THEN concat('fe80::1 and ::', CAST(event_id % 10000 AS STRING))
  ELSE concat('order #', CAST(event_id AS STRING)) END"""
_OTHER_LINE = """CASE event_id % 7
  WHEN 0 THEN concat('<131>Jan 15 08:30:45 host', CAST(event_id % 5 AS STRING), ' app[12]: message ', CAST(event_id AS STRING))
  WHEN 1 THEN concat('something warning happened id ', CAST(event_id AS STRING))
  WHEN 2 THEN concat('Mon, 15 Jan 2024 10:30:45 +0200 hello ', CAST(event_id AS STRING))
  WHEN 3 THEN concat('2024/01/15 08:30:45 slashed ', CAST(event_id AS STRING))
  WHEN 4 THEN '   '
  WHEN 5 THEN concat('no stamp and no word of a kind ', CAST(event_id AS STRING))
  ELSE concat('2024-01-15T08:30:45.250Z ERROR strict ', CAST(event_id AS STRING)) END"""
_NESTED_LINE = """concat('{"time":"2024-01-15 08:30:45","msg":"m","level":"info","list":[["10.1.2.', CAST(event_id % 256 AS STRING), '"],"x"],"n":4111111111111111,"none":null,"s":"a ', chr(92), '"q', chr(92), '" u@ex.com","user":{"ips":["10.9.8.7",7],"mail":"u', CAST(event_id AS STRING), '@ex.com","ok":true}}')"""
_SEVERITY = "CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'WARNING' ELSE 'INFO' END AS severity"
_TYPE = "CASE event_type WHEN 'error' THEN 'error_rate_surge' WHEN 'purchase' THEN 'frequency_spike' ELSE 'new_pattern' END AS alert_type"
_SOURCE = "concat('u', CAST(user_id % 10 AS STRING)) AS source"


def _events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", *columns)


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = {"detector": "frequency", "description": "d", "trigger_value": 1.0, "threshold": 1.0, "baseline_value": 1.0, "line_start": 1, "line_end": 2}
    return _events(spark, sf_dir, "event_id AS alert_id", "CAST(ts AS timestamp) AS ts", _SEVERITY, _TYPE, _SOURCE).drop("event_id").withColumns({c: F.lit(v) for c, v in fixed.items()})


def detect_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All built-in kinds, overlaps and near misses: the kinds found and the sanitized text."""
    rows = sanitize(_events(spark, sf_dir, f"{_KIND_TEXT} AS text").repartition(spark.sparkContext.defaultParallelism, "event_id"), "text")
    return rows.select("event_id", F.array_join(F.transform("found", lambda m: m["kind"]), ",").alias("kinds"), "sanitized")


def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom rules of all strategies."""
    rules = [custom_rule("h", r"tag-(?P<n>\d+)", "tag", "hash", {"hash_length": 8}), custom_rule("d", r"code-(\d+)", strategy="delete"), custom_rule("g", r"ref-\d+", strategy="generalize"), custom_rule("r", r"key\d+", "secret_key", "replace"), custom_rule("m", r"who-[a-z]+", strategy="mask", params={"keep_start": 4, "keep_end": 0, "mask_char": "#"})]
    return sanitize(_events(spark, sf_dir, "concat('tag-', event_id, ' code-', event_id, ' ref-', event_id, ' key', event_id, ' who-', event_type) AS text"), "text", rules).select("event_id", "sanitized")


def parse_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older syslog form, loose plain text, other stamps, blank and unparseable lines, each line by the first format that fits."""
    lines = _events(spark, sf_dir, "'f' AS source_file", f"{_OTHER_LINE} AS raw").withColumnRenamed("event_id", "line_no").repartition(spark.sparkContext.defaultParallelism, "line_no")
    return parse_lines(lines, year=2024, sticky=False).select("line_no", "fmt", "level", "message", F.unix_millis("ts").alias("ms"), "parse_error", F.element_at("extra", "hostname").alias("hostname"))


def parse_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A custom pattern with named groups and other names of fields."""
    lines = _events(spark, sf_dir, "'f' AS source_file", "CASE WHEN event_id % 9 = 0 THEN concat('#', event_id) ELSE concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), '|ERROR|svc', event_id % 3, '|', props) END AS raw").withColumnRenamed("event_id", "line_no")
    rows = parse_lines(lines, "custom", custom=r"(?P<when>[^|]+)\|(?P<level>[A-Z]+)\|(?P<service>\w+)\|(?P<text>.*)", names={"timestamp": "when", "message": "text"})
    return rows.select("line_no", "fmt", "level", "message", F.unix_seconds("ts").alias("epoch"), F.element_at("extra", "service").alias("service"))


def sanitize_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with nested values: their extra sanitized leaf by leaf, types kept, the paths of what was found, fields counted. Keys come in order of name."""
    lines = _events(spark, sf_dir, "'f' AS source_file", f"{_NESTED_LINE} AS raw").withColumnRenamed("event_id", "line_no").repartition(spark.sparkContext.defaultParallelism, "line_no")
    rows = L.standard(L.sanitize_records(parse_lines(lines, "json")))
    return rows.select("line_no", "json", F.array_join(F.transform("found", lambda d: d["field"]), ",").alias("fields"), F.col("total_fields").cast("long").alias("total_fields"), F.col("sanitized_fields").cast("long").alias("sanitized_fields"))


def mapping_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over parts of the lines whose rule masks differently; values that the first has seen keep its replacement in the second."""
    store, out = MappingStore(f"{shared_dir(spark)}/lumenlog/mapping-{uuid.uuid4().hex}", "k"), []
    for first, shown in ((True, 4), (False, 5)):
        rule = custom_rule("user", r"user-\d+", params={"keep_start": shown, "keep_end": 1})
        lines = _events(spark, sf_dir, "'f' AS source_file", "concat('x user-', user_id, ' and user-', event_id % 100) AS message", "true AS is_parseable", "CAST(map() AS map<string,string>) AS extra", "ts < '2024-01-10' AS early").withColumnRenamed("event_id", "line_no")
        staged = settle(L.detected_records(lines.filter("early" if first else "NOT early"), [rule]), "found")
        out.append(settle(L.spliced_records(mapped_records(staged, store)).select("line_no", "message"), "mapped"))
    return out[0].unionByName(out[1])


def nested_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and values of the strings in JSON texts, and the parts of the paths."""
    found = _events(spark, sf_dir, f"{_NESTED_LINE} AS raw").filter("event_id % 10 = 0").select("event_id", F.explode(N.leaves(F.col("raw"), F.lit("r"))).alias("leaf"))
    return found.select("event_id", "leaf.path", "leaf.value", F.size(N.field_path(F.col("leaf.path"))).cast("long").alias("parts"))


def report_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit statistics under a filter: all lines count, fields only of those that pass."""
    lines = _events(spark, sf_dir, "concat('f', user_id % 3) AS source_file", "CASE WHEN event_id % 8 = 0 THEN 'junk' ELSE concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), CASE event_type WHEN 'error' THEN ' [ERROR] ' ELSE ' [INFO] ' END, 'from 10.0.0.1') END AS raw").withColumnRenamed("event_id", "line_no")
    records = L.sanitize_records(parse_lines(lines, "plaintext"))
    stats = L.file_stats(records, ~F.col("is_parseable") | L.keep(levels=["FATAL"]))
    return stats.select("source_file", "total_lines", "parsed_lines", "unparsed_lines", F.col("total_fields").cast("long").alias("total_fields"), F.col("sanitized_fields").cast("long").alias("sanitized_fields"), "bytes")


def late_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates that first come after 100 lines of a source, over messages whose words change with time."""
    rows = _events(spark, sf_dir, "concat('u', user_id % 10) AS source", "event_type", "user_id").withColumnRenamed("event_id", "line_no")
    phase = S.code_point(97 + F.col("line_no") % 20 * F.floor(F.col("line_no") / 3000))
    return D.new_patterns(rows.select("line_no", "source", F.concat("event_type", F.lit(" phase "), phase, F.lit(" of "), "user_id").alias("message")), 100, slot=64)


def alerts_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of a source and type at least six hours after the last kept one."""
    return A.dedup(_alerts(spark, sf_dir), 21600).groupBy("source", "alert_type").agg(F.count("*").alias("n"), F.sum(F.unix_seconds("ts")).alias("total"))


def alerts_correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spikes and surges of a source within three hours become composites, each alert in one at most; and which alerts still wait."""
    out = A.pair_up(A.dedup(_alerts(spark, sf_dir).drop("alert_id"), 3600), 10800)
    return out.select("source", "alert_type", "severity", F.unix_micros("ts").alias("micros"), F.col("_open").alias("waits"))


def alerts_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rules do to alerts: dropped, downgraded, held back and released."""
    rules = [A.Suppression("off", "suppress", enabled=False), A.Suppression("night", "suppress", cron="* 0-5 * * *", alert_types=("new_pattern",)), A.Suppression("calm", "downgrade", severities=("WARNING", "CRITICAL"), source_pattern="^u[0-4]$"), A.Suppression("wait", "delay", alert_types=("error_rate_surge",), delay_seconds=3600)]
    return A.release(A.apply_suppression(_alerts(spark, sf_dir), rules)).select("alert_id", "severity", "rule", "action")


def suppression_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often and when last rules matched."""
    rules = [A.Suppression("night", "suppress", cron="*/2 0-5 1,15 * *"), A.Suppression("rest", "downgrade", severities=("WARNING",))]
    return A.suppression_hits(A.apply_suppression(_alerts(spark, sf_dir), rules)).select("rule", "hit_count", F.unix_seconds("last_hit").alias("last_hit"))


def alerts_tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds after feedback on every seventh alert, in order."""
    told = _events(spark, sf_dir, "event_id AS alert_id", "event_id AS at", "CASE WHEN event_id % 14 = 0 THEN event_id % 3 > 0 WHEN event_id % 7 = 0 THEN user_id % 2 = 0 END AS is_false_positive", "'acknowledge' AS action")
    return A.tuned_thresholds(told, _alerts(spark, sf_dir)).select("detector", "source", F.round("threshold", 9).alias("threshold"))


def alerts_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts' states after feedback in order; of the resolved ones the newest hundred."""
    steps = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id % 1000 AS alert_id", "event_id AS at", "CASE event_type WHEN 'error' THEN 'reopen' WHEN 'purchase' THEN 'resolve' WHEN 'signup' THEN 'acknowledge' ELSE 'look' END AS action")
    out = A.lifecycle(_alerts(spark, sf_dir).filter("alert_id < 1000"), steps)
    return A.listing(out, source_pattern="^u[0-6]$").select("alert_id", "status", "source")


def alerts_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every time that an alert was resolved, and what it was before."""
    steps = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id DIV 5 AS alert_id", "event_id AS at", "CASE event_type WHEN 'error' THEN 'reopen' WHEN 'purchase' THEN 'resolve' WHEN 'click' THEN 'resolve' WHEN 'signup' THEN 'acknowledge' ELSE 'look' END AS action")
    return A.resolutions(_alerts(spark, sf_dir), steps).select("alert_id", "source", "old_status", "new_status", "nth")


def alert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert statistics by each dimension."""
    return A.alert_stats(_alerts(spark, sf_dir))


QUERIES = {
    "detect_kinds": detect_kinds, "strategies": strategies, "parse_other": parse_other, "parse_named": parse_named, "sanitize_nested": sanitize_nested, "mapping_two_runs": mapping_two_runs, "nested_leaves": nested_leaves,
    "report_filtered": report_filtered, "late_patterns": late_patterns, "alerts_dedup": alerts_dedup, "alerts_correlated": alerts_correlated, "alerts_suppressed": alerts_suppressed, "suppression_hits": suppression_hits,
    "alerts_tuned": alerts_tuned, "alerts_lifecycle": alerts_lifecycle, "alerts_resolved": alerts_resolved, "alert_counts": alert_counts,
}

_LUHN = "list_sum(list_transform(range(len({v})), lambda i: CASE WHEN i % 2 = 0 THEN {v}[len({v}) - i]::INT ELSE CASE WHEN {v}[len({v}) - i]::INT > 4 THEN {v}[len({v}) - i]::INT * 2 - 9 ELSE {v}[len({v}) - i]::INT * 2 END END)) % 10 = 0"
_CARD_CODE = "(['1','0','X','9','8','7','6','5','4','3','2'])[list_sum(list_transform(range(1, 18), lambda k: substr(v, k, 1)::INT * ([7,9,10,5,8,4,2,1,6,3,7,9,10,5,8,4,2])[k]))::INT % 11 + 1] = substr(v, 18, 1)"
_A = f"a AS (SELECT event_id AS alert_id, ts, {_SEVERITY}, {_TYPE}, {_SOURCE} FROM events)"


def fold_sql(rows: str, seconds: int) -> str:
    """pairs (source, spike, surge) and ends (source, spike, surge) of rows (source, kind, us, n from 1 in order), in microseconds: what two slots a source hold, row by row."""
    spike, surge = "CASE WHEN o.kind = 0 THEN o.us ELSE f.spike END", "CASE WHEN o.kind = 1 THEN o.us ELSE f.surge END"
    met = f"coalesce(abs({spike} - ({surge})) <= {seconds * 1_000_000}, false)"
    return f"""f AS (SELECT DISTINCT source, 0::BIGINT AS n, NULL::BIGINT AS spike, NULL::BIGINT AS surge, NULL::BIGINT AS a, NULL::BIGINT AS b FROM {rows}
  UNION ALL SELECT o.source, o.n, CASE WHEN {met} THEN NULL ELSE {spike} END, CASE WHEN {met} THEN NULL ELSE {surge} END, CASE WHEN {met} THEN {spike} END, CASE WHEN {met} THEN {surge} END FROM f JOIN {rows} o ON o.source = f.source AND o.n = f.n + 1),
pairs AS (SELECT source, a AS spike, b AS surge FROM f WHERE a IS NOT NULL), ends AS (SELECT source, arg_max_null(spike, n) AS spike, arg_max_null(surge, n) AS surge FROM f GROUP BY source)"""


SQL = {
    "detect_kinds": f"""
WITH t AS (SELECT event_id, event_id % 11 AS k, {_KIND_TEXT} AS text FROM events),
v AS (SELECT *, CASE k WHEN 2 THEN substr(text, 4) WHEN 7 THEN substr(text, 6) ELSE '0' END AS v FROM t),
c AS (SELECT *, {_LUHN.format(v="v")} AS luhn, CASE WHEN k = 2 THEN {_CARD_CODE} ELSE false END AS card FROM v)
SELECT event_id,
  CASE k WHEN 0 THEN 'ipv6' WHEN 1 THEN 'phone' WHEN 2 THEN CASE WHEN card THEN 'id_card' WHEN luhn THEN 'bank_card' ELSE '' END WHEN 3 THEN 'token' WHEN 4 THEN 'cookie' WHEN 5 THEN 'token,token' WHEN 6 THEN 'email'
    WHEN 7 THEN CASE WHEN luhn THEN 'bank_card' ELSE '' END WHEN 8 THEN 'phone' WHEN 9 THEN 'ipv6' ELSE '' END AS kinds,
  CASE k WHEN 0 THEN 'addr 2001:db8::*' WHEN 1 THEN 'call 138****' || right(lpad(event_id::VARCHAR, 8, '0'), 4) || ' now'
    WHEN 2 THEN CASE WHEN card THEN 'id 1101' || repeat('*', 10) || right(v, 4) WHEN luhn THEN 'id 110101' || repeat('*', 8) || right(v, 4) ELSE text END
    WHEN 3 THEN 'x PHPSESSID=[REDACTED_SESSION]&y' WHEN 4 THEN 'Set-Cookie: [REDACTED_COOKIE]' WHEN 5 THEN 'password: [REDACTED_TOKEN] api_key="[REDACTED_TOKEN]"' WHEN 6 THEN 'mail ***@10.0.0.1.example.com'
    WHEN 7 THEN CASE WHEN luhn THEN 'card 411111******' || right(v, 4) ELSE text END WHEN 8 THEN 'token=138****' || right(text, 4) WHEN 9 THEN 'fe80:::*1 and ::' || (event_id % 10000) ELSE text END AS sanitized FROM c""",
    "strategies": """SELECT event_id, 'tag-' || substr(sha256(event_id::VARCHAR), 1, 8) || ' code- r' || repeat('*', len('ref-' || event_id) - 1) || ' [REDACTED_SECRET_KEY] who-' || repeat('#', len(event_type)) AS sanitized FROM events""",
    "parse_other": f"""WITH t AS (SELECT event_id, event_id % 7 AS k, {_OTHER_LINE} AS raw FROM events)
SELECT event_id AS line_no, CASE WHEN k = 0 THEN 'syslog' WHEN k IN (4, 5) THEN 'unparseable' ELSE 'plaintext' END AS fmt, CASE k WHEN 0 THEN 'WARN' WHEN 1 THEN 'WARN' WHEN 6 THEN 'ERROR' ELSE 'UNKNOWN' END AS level,
  CASE k WHEN 0 THEN 'message ' || event_id WHEN 6 THEN 'strict ' || event_id ELSE raw END AS message,
  CASE k WHEN 0 THEN epoch_ms(TIMESTAMP '2024-01-15 08:30:45') WHEN 2 THEN epoch_ms(TIMESTAMP '2024-01-15 08:30:45') WHEN 3 THEN epoch_ms(TIMESTAMP '2024-01-15 08:30:45') WHEN 6 THEN epoch_ms(TIMESTAMP '2024-01-15 08:30:45.250') END AS ms,
  CASE k WHEN 4 THEN 'Empty line' WHEN 5 THEN 'Format not detected' END AS parse_error, CASE k WHEN 0 THEN 'host' || (event_id % 5) END AS hostname FROM t""",
    "parse_named": """SELECT event_id AS line_no, CASE WHEN event_id % 9 = 0 THEN 'unparseable' ELSE 'custom' END AS fmt, CASE WHEN event_id % 9 = 0 THEN 'UNKNOWN' ELSE 'ERROR' END AS level,
  CASE WHEN event_id % 9 = 0 THEN '#' || event_id ELSE props END AS message, CASE WHEN event_id % 9 > 0 THEN epoch(date_trunc('second', ts))::BIGINT END AS epoch, CASE WHEN event_id % 9 > 0 THEN 'svc' || (event_id % 3) END AS service FROM events""",
    "sanitize_nested": """SELECT event_id AS line_no, '{"timestamp":"2024-01-15T08:30:45+00:00","level":"INFO","source":"f","message":"m","extra":{"list":[["10.1.*.*"],"x"],"n":4111111111111111,"none":null,"s":"a \\"q\\" ***@ex.com","user":{"ips":["10.9.*.*",7],"mail":"***@ex.com","ok":true}}}' AS json,
  'extra.s,extra.list[0][0],extra.user.ips[0],extra.user.mail' AS fields, 6::BIGINT AS total_fields, 4::BIGINT AS sanitized_fields FROM events""",
    "mapping_two_runs": """WITH e AS (SELECT event_id AS line_no, ts < '2024-01-10' AS early, 'user-' || user_id AS a, 'user-' || (event_id % 100) AS b FROM events),
s AS (SELECT a AS v FROM e WHERE early UNION SELECT b FROM e WHERE early),
m AS (SELECT v, CASE WHEN len(v) <= k + 1 THEN repeat('*', len(v)) ELSE substr(v, 1, k) || repeat('*', len(v) - k - 1) || right(v, 1) END AS masked FROM (SELECT v, CASE WHEN v IN (SELECT v FROM s) THEN 4 ELSE 5 END AS k FROM (SELECT a AS v FROM e UNION SELECT b FROM e)))
SELECT line_no, 'x ' || x.masked || ' and ' || y.masked AS message FROM e JOIN m x ON x.v = a JOIN m y ON y.v = b""",
    "nested_leaves": """SELECT event_id, p.path, CASE p.path WHEN 'r.list[0][0]' THEN '10.1.2.' || (event_id % 256) WHEN 'r.user.mail' THEN 'u' || event_id || '@ex.com' ELSE p.v END AS value, p.parts::BIGINT AS parts
FROM events, (VALUES ('r.time', '2024-01-15 08:30:45', 2), ('r.msg', 'm', 2), ('r.level', 'info', 2), ('r.list[0][0]', '', 4), ('r.list[1]', 'x', 3), ('r.s', 'a "q" u@ex.com', 2), ('r.user.ips[0]', '10.9.8.7', 4), ('r.user.mail', '', 3)) AS p(path, v, parts) WHERE event_id % 10 = 0""",
    "report_filtered": """SELECT 'f' || (user_id % 3) AS source_file, count(*) AS total_lines, count(*) FILTER (event_id % 8 > 0) AS parsed_lines, count(*) FILTER (event_id % 8 = 0) AS unparsed_lines,
  count(*) FILTER (event_id % 8 > 0 AND event_type = 'error') AS total_fields, count(*) FILTER (event_id % 8 > 0 AND event_type = 'error') AS sanitized_fields,
  sum(CASE WHEN event_id % 8 = 0 THEN 5 WHEN event_type = 'error' THEN 42 ELSE 41 END)::BIGINT AS bytes FROM events GROUP BY ALL""",
    "late_patterns": """WITH e AS (SELECT event_id AS line_no, 'u' || (user_id % 10) AS source, event_type || ' phase ' || chr((97 + event_id % 20 * (event_id // 3000))::INT) || ' of <NUM>' AS t FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY line_no) AS nth FROM e)
SELECT source, regexp_replace(t, '\\b\\d+\\b', '<NUM>', 'g') AS template, min(line_no) AS line_no FROM n GROUP BY ALL HAVING min(nth) > 100""",
    "alerts_dedup": f"""WITH RECURSIVE {_A}, s AS (SELECT DISTINCT source, alert_type, ts FROM a),
k AS (SELECT source, alert_type, min(ts) AS ts FROM s GROUP BY ALL
  UNION ALL SELECT k.source, k.alert_type, n.ts FROM k, LATERAL (SELECT min(s.ts) AS ts FROM s WHERE s.source = k.source AND s.alert_type = k.alert_type AND s.ts >= k.ts + INTERVAL 6 HOUR) n WHERE n.ts IS NOT NULL)
SELECT source, alert_type, count(*) AS n, sum(floor(epoch(ts)))::BIGINT AS total FROM k GROUP BY ALL""",
    "alerts_correlated": f"""WITH RECURSIVE {_A}, s AS (SELECT DISTINCT source, alert_type, ts FROM a),
k AS (SELECT source, alert_type, min(ts) AS ts FROM s GROUP BY ALL
  UNION ALL SELECT k.source, k.alert_type, n.ts FROM k, LATERAL (SELECT min(s.ts) AS ts FROM s WHERE s.source = k.source AND s.alert_type = k.alert_type AND s.ts >= k.ts + INTERVAL 1 HOUR) n WHERE n.ts IS NOT NULL),
o AS (SELECT source, (alert_type = 'error_rate_surge')::INT AS kind, epoch_us(ts) AS us, row_number() OVER (PARTITION BY source ORDER BY ts, alert_type = 'error_rate_surge') AS n FROM k WHERE alert_type <> 'new_pattern'),
{fold_sql("o", 10800)}
SELECT source, 'composite_anomaly' AS alert_type, 'CRITICAL' AS severity, greatest(spike, surge) AS micros, false AS waits FROM pairs
UNION ALL SELECT k.source, k.alert_type, CASE k.alert_type WHEN 'error_rate_surge' THEN 'CRITICAL' WHEN 'frequency_spike' THEN 'WARNING' ELSE 'INFO' END, epoch_us(k.ts), coalesce(k.alert_type <> 'new_pattern' AND epoch_us(k.ts) IN (e.spike, e.surge), false)
FROM k LEFT JOIN ends e ON e.source = k.source WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.source = k.source AND epoch_us(k.ts) = CASE k.alert_type WHEN 'frequency_spike' THEN p.spike WHEN 'error_rate_surge' THEN p.surge END)""",
    "alerts_suppressed": f"""WITH {_A}, j AS (SELECT *, CASE WHEN alert_type = 'new_pattern' AND hour(ts) <= 5 THEN 'night' WHEN severity IN ('WARNING', 'CRITICAL') AND regexp_matches(source, '^u[0-4]$') THEN 'calm' WHEN alert_type = 'error_rate_surge' THEN 'wait' END AS rule FROM a)
SELECT alert_id, CASE WHEN rule = 'calm' THEN CASE severity WHEN 'CRITICAL' THEN 'WARNING' ELSE 'INFO' END ELSE severity END AS severity, rule, CASE rule WHEN 'calm' THEN 'downgrade' WHEN 'wait' THEN 'delay' END AS action FROM j
WHERE rule IS NULL OR rule = 'calm' OR (rule = 'wait' AND EXISTS (SELECT 1 FROM a WHERE a.source = j.source AND a.alert_type = j.alert_type AND a.ts > j.ts AND a.ts <= j.ts + INTERVAL 1 HOUR))""",
    "suppression_hits": f"""WITH {_A}, j AS (SELECT ts, CASE WHEN minute(ts) % 2 = 0 AND hour(ts) <= 5 AND day(ts) IN (1, 15) THEN 'night' WHEN severity = 'WARNING' THEN 'rest' END AS rule FROM a)
SELECT rule, count(*) AS hit_count, floor(epoch(max(ts)))::BIGINT AS last_hit FROM j WHERE rule IS NOT NULL GROUP BY ALL""",
    "alerts_tuned": """WITH RECURSIVE f AS (SELECT 'u' || (user_id % 10) AS source, CASE WHEN event_id % 14 = 0 THEN event_id % 3 > 0 ELSE user_id % 2 = 0 END AS fp, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS k FROM events WHERE event_id % 7 = 0),
r AS (SELECT source, 0::BIGINT AS k, 3.0::DOUBLE AS t FROM f GROUP BY source UNION ALL SELECT r.source, f.k, CASE WHEN f.fp THEN least(r.t * 1.05::DOUBLE, 9.0::DOUBLE) ELSE greatest(r.t * 0.98::DOUBLE, 0.3::DOUBLE * 3) END FROM r JOIN f ON f.source = r.source AND f.k = r.k + 1)
SELECT 'frequency' AS detector, source, round(arg_max(t, k), 9) AS threshold FROM r GROUP BY source""",
    "alerts_lifecycle": f"""WITH {_A}, f AS (SELECT event_id % 1000 AS alert_id, event_id AS step, event_type AS x FROM events WHERE event_type IN ('error', 'purchase', 'signup')),
l AS (SELECT alert_id, max(step) AS latest, max(step) FILTER (x IN ('error', 'purchase')) AS turn, arg_max(x, step) FILTER (x IN ('error', 'purchase')) AS x, max(step) FILTER (x = 'signup') AS ack FROM f GROUP BY alert_id),
s AS (SELECT a.alert_id, a.source, l.latest, CASE WHEN l.x = 'purchase' THEN 'resolved' WHEN l.ack IS NOT NULL AND l.ack > coalesce(l.turn, -1) THEN 'acknowledged' ELSE 'active' END AS status FROM a LEFT JOIN l USING (alert_id) WHERE a.alert_id < 1000),
n AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY latest DESC, alert_id) AS k FROM s)
SELECT alert_id, status, source FROM n WHERE (status <> 'resolved' OR k <= 100) AND regexp_matches(source, '^u[0-6]$')""",
    "alerts_resolved": f"""WITH RECURSIVE {_A}, f AS (SELECT event_id // 5 AS alert_id, CASE event_type WHEN 'error' THEN 'active' WHEN 'signup' THEN 'acknowledged' ELSE 'resolved' END AS x, row_number() OVER (PARTITION BY event_id // 5 ORDER BY event_id) AS n
  FROM events WHERE event_type IN ('error', 'purchase', 'click', 'signup')),
s AS (SELECT DISTINCT alert_id, 0::BIGINT AS n, 'active' AS old, 'active' AS now, 0 AS nth FROM f
  UNION ALL SELECT s.alert_id, f.n, s.now, CASE WHEN f.x = 'acknowledged' AND s.now = 'resolved' THEN s.now ELSE f.x END, s.nth + (f.x = 'resolved' AND s.now <> 'resolved')::INT FROM s JOIN f ON f.alert_id = s.alert_id AND f.n = s.n + 1)
SELECT s.alert_id, a.source, s.old AS old_status, 'resolved' AS new_status, s.nth FROM s JOIN a USING (alert_id) WHERE s.now = 'resolved' AND s.old <> 'resolved'""",
    "alert_counts": f"""WITH {_A} SELECT 'total' AS dimension, 'all' AS value, count(*) AS n FROM a UNION ALL SELECT 'severity', severity, count(*) FROM a GROUP BY severity UNION ALL SELECT 'alert_type', alert_type, count(*) FROM a GROUP BY alert_type
UNION ALL SELECT 'source', source, count(*) FROM a GROUP BY source UNION ALL SELECT 'detector', 'frequency', count(*) FROM a""",
}
