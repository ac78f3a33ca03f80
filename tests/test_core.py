"""Scalars, detection, parsers, detectors and alerts on small literals."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumenlog.functions import scalars as S
from lumenlog.operators import alerts as A
from lumenlog.operators import detectors as D
from lumenlog.operators import pipeline as L
from lumenlog.operators.detect import BUILTIN, configured, custom_rule, detections, sanitize, splice
from lumenlog.operators.parse import parse_custom, parse_lines


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(("f", "value", "want"), [
    (S.luhn_ok, "79927398713", True), (S.luhn_ok, "4111111111111111", True), (S.luhn_ok, "1234567890123456", False), (S.luhn_ok, "0000000000000000", False), (S.luhn_ok, None, False),
    (S.id_card_ok, "110101199001011237", True), (S.id_card_ok, "110101199001011234", False), (S.id_card_ok, "12345", False),
    (S.is_id_field, "orderNumber", True), (S.is_id_field, "UUID", True), (S.is_id_field, "email", False), (S.is_id_field, None, False),
    (S.parse_log_level, "[INFO] message", "INFO"), (S.parse_log_level, "warn: test", "WARN"), (S.parse_log_level, "Debug mode", "DEBUG"), (S.parse_log_level, "none", "UNKNOWN"),
    (S.mask_value, "13800138000", "138****8000"), (S.mask_value, "short", "*****"),
    (S.generalize_ip, "192.168.1.100", "192.168.*.*"), (S.generalize_ip, "2001:db8:85a3::8a2e:370:7334", "2001:db8::*"), (S.generalize_ip, "invalid", "invalid"),
    (S.generalize_email, "user@example.com", "***@example.com"), (S.generalize_email, "plain", "plain"),
    (S.templatize, "GET /api/users/123/profile", "GET /api/users/<VAR>/profile"), (S.templatize, "User 123 from 10.0.0.1 emailed admin@test.com", "User <NUM> from <IP> emailed <EMAIL>"),
])
def test_scalars(spark, f, value, want):
    assert one(spark, f, value) == want


@pytest.mark.parametrize("value", ["2024-01-15 08:30:45", "2024-01-15T08:30:45Z", "15/Jan/2024:08:30:45 +0000", "2024/01/15 08:30:45", "2024-01-15T10:30:45+02:00"])
def test_timestamps(spark, value):
    assert one(spark, lambda c: F.date_format(S.parse_timestamp(c), "yyyy-MM-dd HH:mm:ss"), value) == "2024-01-15 08:30:45"


def test_modified_z(spark):
    z = lambda values, x: spark.range(1).select(S.modified_z(F.array(*map(F.lit, values)).cast("array<double>"), F.lit(float(x)))).first()[0]
    assert z([1, 2, 3, 4, 5], 10) > 2
    assert (z([2, 2, 2, 2], 2), z([2, 2, 2, 2], 5), z([], 1)) == (0, float("inf"), 0)


@pytest.mark.parametrize(("text", "want"), [
    ("ip 192.168.1.100 mail test@example.com", "ip 192.168.*.* mail ***@example.com"), ("phone 13812345678.", "phone 138****5678."),
    ("card 4111111111111111 id 110101199001011237", "card 411111******1111 id 1101**********1237"), ("password: pass token=abc123", "password: [REDACTED_TOKEN] token=[REDACTED_TOKEN]"),
    ("PHPSESSID=77 x", "PHPSESSID=[REDACTED_SESSION] x"), ("Cookie: sid=1; b", "Cookie: [REDACTED_COOKIE]"), ("😀 号 10.0.0.1 é", "😀 号 10.0.*.* é"), ("order #12345", "order #12345"), ("", ""), (None, None),
])
def test_sanitize(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert sanitize(df, "t").first()["sanitized"] == want


def test_rules(spark):
    rules = configured({"email": {"strategy": "hash", "params": {"hash_length": 8}}, "ipv4": {"enabled": False}}, [custom_rule("tag", r"tag-(?P<n>\d+)", strategy="delete")])
    row = sanitize(spark.createDataFrame([("a@b.cd 10.0.0.1 tag-55",)], "t string"), "t", rules).first()
    assert row["sanitized"].endswith(" 10.0.0.1 tag-") and len(row["sanitized"].split()[0]) == 8
    for bad in (lambda: custom_rule("x", "("), lambda: custom_rule("x", ""), lambda: custom_rule("x", "a", strategy="no"), lambda: configured({"email": {"strategy": "no"}})):
        with pytest.raises(ValueError):
            bad()
    phone = spark.createDataFrame([("13812345678",)], "v string").select(F.size(detections(F.col("v"), BUILTIN, F.lit("order_no")))).first()[0]
    assert phone == 0 and splice is not None


def lines(spark, rows):
    return spark.createDataFrame([("f", k, r) for k, r in enumerate(rows)], "source_file string, line_no long, raw string")


@pytest.mark.parametrize(("fmt", "raw", "level", "message", "key", "value"), [
    ("json", '{"timestamp": "2024-01-15T08:30:45Z", "level": "INFO", "message": "user login success", "user_id": 123}', "INFO", "user login success", "user_id", "123"),
    ("apache", '192.168.1.100 - - [15/Jan/2024:08:30:45 +0000] "GET /api/users HTTP/1.1" 200 1234 "http://example.com" "Mozilla/5.0"', "INFO", "GET /api/users HTTP/1.1", "status", "200"),
    ("syslog", "<134>Jan 15 08:30:45 server1 sshd[1234]: Accepted password for user1", "INFO", "Accepted password for user1", "pid", "1234"),
    ("syslog", '<165>1 2024-01-15T08:30:45.003Z server1 sshd 1234 ID47 [meta sequenceId="1"] Accepted', "INFO", "Accepted", "hostname", "server1"),
    ("plaintext", "2024-01-15 08:30:45 [INFO] user login success, ip=192.168.1.100", "INFO", "user login success, ip=192.168.1.100", "x", None),
])
def test_parsers(spark, fmt, raw, level, message, key, value):
    row = parse_lines(lines(spark, [raw])).first()
    assert (row.fmt, row.level, row.message, row.extra.get(key), row.is_parseable) == (fmt, level, message, value, True)


def test_unparseable_custom_and_sticky(spark):
    rows = parse_lines(lines(spark, ["", "junk", "2024-01-15 08:30:45 [WARNING] a", '{"message": "b"}'])).orderBy("line_no").collect()
    assert [r.fmt for r in rows] == ["unparseable", "unparseable", "plaintext", "unparseable"] and rows[0].parse_error == "Empty line"
    assert parse_lines(lines(spark, ["no json"]), "json").first().parse_error.startswith("JSON parse error")
    pattern = r"(?P<timestamp>\S+ \S+) \[(?P<level>[A-Z]+)\] (?P<service>[a-z]+): (?P<message>.*)$"
    row = lines(spark, ["2024-01-15 08:30:45 [ERROR] auth: login failed"]).select(parse_custom(F.col("raw"), pattern).alias("r")).first()["r"]
    assert (row.level, row.extra["service"], row.message) == ("ERROR", "auth", "login failed")


def test_pipeline(spark):
    rows = parse_lines(lines(spark, ["2024-01-15 08:30:45 [ERROR] from 10.0.0.1", "2024-01-15 08:30:46 [INFO] ok", "junk"]), "plaintext")
    clean = L.sanitize_records(L.filter_records(rows, levels=["FATAL"]))
    out = {r.line_no: r.json for r in L.standard(clean).collect()}
    assert out[0] == '{"timestamp":"2024-01-15T08:30:45+00:00","level":"ERROR","source":"f","message":"from 10.0.*.*","extra":{}}'
    assert '"_unparseable":true' in out[2] and 1 not in out
    stats = L.audit_report(L.file_stats(clean)).first()
    assert (stats.total_lines, stats.unparsed_lines, stats.sanitized_fields, stats.failure_rate) == (2, 1, 1, 0.5)
    assert [tuple(r) for r in L.top_fields(clean).collect()] == [("message", 1)]
    assert L.audit_log(clean).first().sanitized_value == "10.0.*.*"


def series(spark, rows):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([("s", start + dt.timedelta(seconds=t), level, m, k) for k, (t, level, m) in enumerate(rows)], "source string, ts timestamp, level string, message string, line_no long")


def test_detectors(spark):
    burst = [(0.2 * k, "INFO", "a") for k in range(10)] + [(2.2 + 0.01 * k, "INFO", "a") for k in range(30)]
    kinds = lambda rows, **c: [r.alert_type for r in D.anchored_alerts(series(spark, rows), D.DetectorConfig(window_seconds=1, **c)).collect()]
    assert kinds(burst, multiplier=2) == ["frequency_spike"]
    rates = [(1.1 * w + 0.01 * k, "ERROR" if w == 5 and k < 8 else "INFO", "a") for w in range(6) for k in range(10)]
    assert "error_rate_surge" in kinds(rates, multiplier=99, z_threshold=1.0)
    assert kinds([(0.01 * k, "INFO", "same") for k in range(10)] + [(0.2, "INFO", "new one")], min_samples=5, multiplier=99) == ["new_pattern"]
    assert "pattern_disappeared" in kinds([(0, "INFO", "A"), (0.1, "INFO", "A"), (0.2, "INFO", "B"), *[(1.5 * k, "INFO", "B") for k in range(1, 6)]], disappear_windows=2, multiplier=99)


def alert(t, kind, source="s", severity="WARNING"):
    return (dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t), severity, kind, source, "frequency", 2.0, 1.0, 1.0, 1, 2, kind)


def test_alerts(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), D.ALERT)
    assert A.dedup(frame(alert(0, "frequency_spike"), alert(100, "frequency_spike"))).count() == 1
    assert A.dedup(frame(alert(0, "frequency_spike"), alert(700, "frequency_spike"))).count() == 2
    both = A.correlate(frame(alert(0, "frequency_spike"), alert(10, "error_rate_surge"), alert(500, "error_rate_surge"))).collect()
    assert sorted((r.alert_type, r.severity) for r in both) == [("composite_anomaly", "CRITICAL"), ("error_rate_surge", "WARNING")]
    rules = [A.Suppression("d", "delay", alert_types=("new_pattern",), delay_seconds=60), A.Suppression("down", "downgrade", source_pattern="^s$")]
    judged = A.apply_suppression(frame(alert(0, "new_pattern"), alert(30, "new_pattern"), alert(0, "frequency_spike")), rules)
    assert sorted((r.alert_type, r.severity) for r in A.release(judged).collect()) == [("frequency_spike", "INFO"), ("new_pattern", "WARNING")]
    alerts = frame(alert(0, "frequency_spike")).withColumn("alert_id", F.lit("x"))
    told = spark.createDataFrame([("x", "acknowledge", True, 1), ("x", "resolve", None, 2), ("x", "reopen", None, 3)], "alert_id string, action string, is_false_positive boolean, at long")
    assert A.lifecycle(alerts, told).first().status == "active" and A.lifecycle(alerts, told.filter("at < 3")).first().status == "resolved"
    assert A.tuned_thresholds(told, alerts).first().threshold == pytest.approx(3.0 * 1.05)
    with pytest.raises(ValueError):
        A.Suppression("x", "no")


def test_stream_equals_batch(spark, tmp_path):
    from lumenlog.sources.text import read_lines, read_sanitized
    from lumenlog.streaming.live import live_records, start_routed, stream_lines

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("2024-01-15 08:30:45 [ERROR] from 10.0.0.1\n2024-01-15 08:30:46 [INFO] ok\n")
    numbered = read_lines(spark, str(tmp_path / "in")).orderBy("line_no").collect()
    assert [(r.line_no, r.raw[-2:]) for r in numbered] == [(1, ".1"), (2, "ok")]
    start_routed(live_records(stream_lines(spark, str(tmp_path / "in"))), [("ERROR", str(tmp_path / "errors"))], str(tmp_path / "rest"), str(tmp_path / "cp")).awaitTermination()
    assert [r.message for r in read_sanitized(spark, str(tmp_path / "errors")).collect()] == ["from 10.0.*.*"]
    assert [r.message for r in read_sanitized(spark, str(tmp_path / "rest")).collect()] == ["ok"]
