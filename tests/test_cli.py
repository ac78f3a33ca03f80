"""Configuration, command line, webhook delivery and stream metrics."""

import json

import pytest
import yaml

from lumenlog.cli import current_rules, main, tell_resolved
from lumenlog.config import Webhook, load, parse_settings
from lumenlog.operators.detect import BUILTIN
from lumenlog.streaming.live import parsed_records, start_routed, stream_lines
from lumenlog.streaming.notify import send_alerts

BASE = {"inputs": {"paths": ["in"]}, "output": {"file": "out"}}


def test_settings():
    s = parse_settings({
        **BASE, "filters": {"levels": ["error"], "start_time": "2024-01-01"}, "parser": {"format": "nginx"},
        "sanitizers": {"builtin_rules": [{"name": "ipv4", "enabled": False}, {"name": "email", "strategy": "hash"}], "custom_rules": [{"name": "t", "pattern": "t-\\d+", "strategy": "delete"}]},
        "anomaly_detection": {"algorithms": {"frequency": {"threshold_multiplier": {"default": 4, "web": 2}}}, "suppression_rules": [{"name": "n", "action": "downgrade", "match": {"severity": "critical", "alert_type": "new_pattern"}}]},
    })
    names = {r.name: r.strategy for r in s.rules}
    assert "ipv4" not in names and (names["email"], names["t"], s.fmt) == ("hash", "delete", "apache")
    assert (s.detectors.multiplier, s.detectors.threshold("frequency", "web"), s.detectors.window_seconds) == (4.0, 2.0, 300.0)
    assert (s.suppression[0].severities, s.filters) == (("CRITICAL",), {"levels": ["error"], "start": "2024-01-01"})


@pytest.mark.parametrize("doc", [
    [], {}, {"inputs": {"paths": ["in"]}}, {**BASE, "parser": {"format": "odd"}}, {**BASE, "parser": {"format": "custom"}}, {**BASE, "output": {"file": "o", "split_by_time": "year"}},
    {**BASE, "stream": {"low_watermark": 5, "high_watermark": 5}}, {**BASE, "sanitizers": {"custom_rules": [{"name": "x", "pattern": "("}]}}, {**BASE, "filters": ["x"]},
    {**BASE, "anomaly_detection": {"suppression_rules": [{"match": {"severity": "odd"}}]}}, {**BASE, "anomaly_detection": {"suppression_rules": [{"action": "odd"}]}},
])
def test_wrong_settings(doc):
    with pytest.raises(ValueError):
        parse_settings(doc)


def test_run(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("2024-01-15 08:30:45 [INFO] mail a@b.cd\n2024-01-15 08:30:46 [ERROR] from 10.0.0.1\nodd\n")
    doc = {"inputs": {"paths": [str(tmp_path / "in")]}, "output": {"file": str(tmp_path / "out")}, "report_json": str(tmp_path / "r.json"), "report_file": str(tmp_path / "r.txt"), "audit_log": {"enabled": True, "file": str(tmp_path / "audit")}, "anomaly_detection": {"enabled": True, "alert_file": str(tmp_path / "alerts")}}
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(doc))
    config = ["-c", str(tmp_path / "c.yaml")]
    assert main(["validate", *config]) == 0 and main(["validate", "-c", str(tmp_path / "none")]) == 1
    assert main(["run", *config], spark) == 0
    out = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(out) == 3 and not any("a@b.cd" in str(x) or "10.0.0.1" in str(x) for x in out)
    told = json.loads((tmp_path / "r.json").read_text())
    assert (told["summary"]["total_lines"], told["detections"]) == (3, {"email": 1, "ipv4": 1})
    assert spark.read.json(str(tmp_path / "audit")).count() == 2 and "Audit report" in (tmp_path / "r.txt").read_text()
    capsys.readouterr()
    assert main(["detect", "call 13812345678"], spark) == 0 and "138****5678" in capsys.readouterr().out
    assert main(["run", *config, "--dry-run"], spark) == 0
    assert main(["anomaly", "replay", *config, str(tmp_path / "out")], spark) == 0


def test_init(tmp_path, capsys):
    path = str(tmp_path / "c.yaml")
    assert main(["init", path]) == 0 and load(path).file == "./output"
    assert main(["list-rules"]) == 0 and "ipv4" in capsys.readouterr().out
    with pytest.raises(FileExistsError):
        main(["init", path])


def test_webhook(spark, tmp_path):
    alerts = spark.createDataFrame([("a", "CRITICAL"), ("b", "CRITICAL"), ("c", "WARNING")], "source string, severity string")
    calls, dead = [], tmp_path / "dead"

    def send(url, body, headers, timeout):
        calls.append(json.loads(body)["source"])
        if calls[-1] == "b":
            raise OSError("down")

    hook = Webhook("http://host/x", max_retries=2, dead_letter_file=str(dead))
    assert send_alerts(alerts, hook, send, lambda s: None) == (1, 1)
    assert sorted(calls) == ["a", "b", "b", "b"] and json.loads(dead.read_text())["alert"]["source"] == "b"
    assert send_alerts(alerts, Webhook(), send) == (0, 0)


def test_webhook_of_resolved_alerts(spark, tmp_path, monkeypatch):
    """A change of status is posted once, and again after the alert was reopened and resolved anew; a failed one is a dead letter."""
    from lumenlog.operators.detectors import ALERT
    from lumenlog.sources.text import write_alerts
    from lumenlog.streaming import notify

    stamp = "timestamp '2024-01-15 08:30:45'"
    row = lambda k: f"SELECT {', '.join(stamp + ' AS ts' if c.split()[0] == 'ts' else f'CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}' for c in ALERT.split(', ') if c.split()[0] != 'severity')}, 'WARNING' AS severity, '{k}' AS alert_id"
    alerts = spark.sql(" UNION ALL ".join(row(k) for k in "abc")).select(*[c.split()[0] for c in ALERT.split(", ")], "alert_id")
    write_alerts(alerts, str(tmp_path / "alerts"))
    (tmp_path / "feedback").mkdir()
    calls = []

    def send(url, body, headers, timeout):
        doc = json.loads(body)
        calls.append((doc["type"], doc["alert_id"], doc["old_status"], doc["new_status"], doc["alert"]["severity"]))
        if doc["alert_id"] == "b":
            raise OSError("down")

    monkeypatch.setattr(notify.send_changes, "__defaults__", (send, lambda s: None))
    doc = {**BASE, "anomaly_detection": {"enabled": True, "alert_file": str(tmp_path / "alerts"), "feedback_file": str(tmp_path / "feedback"), "webhook": {"url": "http://host/x", "max_retries": 0, "dead_letter_file": str(tmp_path / "dead")}}}
    s, told = parse_settings(doc), str(tmp_path / "told")

    def feed(name, *steps):
        (tmp_path / "feedback" / name).write_text("".join(json.dumps({"alert_id": k, "action": a}) + "\n" for k, a in steps))
        calls.clear()
        return tell_resolved(spark, s, told), sorted(calls)

    change = lambda k, old: ("status_change", k, old, "resolved", "WARNING")
    assert feed("1", ("a", "resolve"), ("a", "resolve"), ("b", "acknowledge"), ("b", "resolve"), ("c", "acknowledge"), ("z", "resolve")) == (2, [change("a", "active"), change("b", "acknowledged")])
    assert json.loads((tmp_path / "dead").read_text())["payload"]["alert_id"] == "b"
    assert feed("1", ("a", "resolve"), ("a", "resolve"), ("b", "acknowledge"), ("b", "resolve"), ("c", "acknowledge"), ("z", "resolve")) == (0, [])
    assert feed("1", ("a", "resolve"), ("a", "reopen"), ("a", "resolve"), ("b", "acknowledge"), ("b", "resolve"), ("c", "resolve")) == (2, [change("a", "active"), change("c", "active")])
    assert tell_resolved(spark, s, None) == 0 and tell_resolved(spark, parse_settings({**doc, "anomaly_detection": {**doc["anomaly_detection"], "alert_file": str(tmp_path / "none")}}), told) == 0


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("2024-01-15 08:30:45 [INFO] mail a@b.cd\n2024-01-15 08:30:46 [ERROR] from 10.0.0.1\n")
    doc = {"inputs": {"paths": [str(tmp_path / "in")]}, "output": {"file": str(tmp_path / "rest")}, "stream": {"route_rules": [{"level_match": "ERROR", "output_target": str(tmp_path / "errors")}]}}
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(doc))
    assert main(["stream", "-c", str(tmp_path / "c.yaml"), "--checkpoint", str(tmp_path / "state"), "--once"], spark) == 0
    assert [spark.read.text(str(tmp_path / d)).count() for d in ("rest", "errors")] == [1, 1]


def test_stream_reads_all_paths_in_a_custom_format(spark, tmp_path):
    (tmp_path / "a" / "deep").mkdir(parents=True)
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "1.log").write_text("INFO|mail a@b.cd\n")
    (tmp_path / "a" / "deep" / "2.log").write_text("ERROR|mail c@d.ef\n")
    (tmp_path / "b" / "3.log").write_text("INFO|from 10.0.0.1\n")
    (tmp_path / "4.log").write_text("INFO|from 10.0.0.2\n")
    doc = {"inputs": {"paths": [str(tmp_path / p) for p in ("a", "b", "4.log")]}, "parser": {"format": "custom", "custom_pattern": r"(?P<lv>[A-Z]+)\|(?P<message>.*)", "custom_field_names": {"level": "lv"}}, "output": {"file": str(tmp_path / "rest")}, "stream": {"route_rules": [{"level_match": "ERROR", "output_target": str(tmp_path / "errors")}]}}
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(doc))
    assert main(["stream", "-c", str(tmp_path / "c.yaml"), "--checkpoint", str(tmp_path / "state"), "--once"], spark) == 0
    rest, errors = ([json.loads(r.value) for r in spark.read.text(str(tmp_path / d)).collect()] for d in ("rest", "errors"))
    assert sorted(r["message"] for r in rest) == ["from 10.0.*.*", "from 10.0.*.*", "mail ***@b.cd"]
    assert [r["message"] for r in errors] == ["mail ***@d.ef"] and not any("_unparseable" in r for r in rest + errors)


def test_stream_reads_rules_again(spark, tmp_path, capsys):
    path = tmp_path / "c.yaml"
    path.write_text(yaml.safe_dump(BASE))
    read = current_rules(str(path), ())
    assert "email" in {r.name for r in read()}
    path.write_text(yaml.safe_dump({**BASE, "sanitizers": {"builtin_rules": {"email": False}}}))
    assert (names := {r.name for r in read()}) and "email" not in names
    path.write_text("[")
    assert {r.name for r in read()} == names and "the rules before stay" in capsys.readouterr().err
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.log").write_text("2024-01-15 08:30:45 [INFO] mail a@b.cd\n")
    turns = iter((parse_settings(BASE).rules, ()))
    records = parsed_records(stream_lines(spark, str(tmp_path / "in"), files_per_trigger=1))
    start_routed(records, (), str(tmp_path / "out"), str(tmp_path / "state"), rules=lambda: next(turns)).awaitTermination()
    assert sorted(json.loads(r.value)["message"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["mail ***@b.cd", "mail a@b.cd"]


def test_stream_judges_across_runs(spark, tmp_path, capsys):
    """A stream that reads a source in pieces, each in a run of its own, alerts as a batch run over the whole does."""
    (tmp_path / "in").mkdir()
    line = lambda h, m, s: json.dumps({"timestamp": f"2024-01-15T{h:02d}:{m:02d}:{s:02d}Z", "level": "INFO", "source": "svc", "message": "tick"})
    calm = [line(8, m, k) for m in range(4) for k in (0, 30)]
    burst = [line(8, 4, k) for k in range(60)] + [line(8, 5, k) for k in range(60)] + [line(8, 6, 0), line(8, 7, 0)]
    doc = {
        "inputs": {"paths": [str(tmp_path / "in")]}, "output": {"file": str(tmp_path / "out")}, "parser": {"format": "json"}, "sanitizers": {"builtin_rules": {r.name: False for r in BUILTIN}},
        "anomaly_detection": {"enabled": True, "alert_file": str(tmp_path / "alerts"), "feedback_file": str(tmp_path / "feedback"), "algorithms": {"frequency": {"window_size_seconds": 60, "threshold_multiplier": 3, "alpha": 0.1}, "error_rate": {"window_size_seconds": 60}}},
    }
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(doc))
    config = ["-c", str(tmp_path / "c.yaml")]

    def alerts():
        capsys.readouterr()
        assert main(["anomaly", "alerts", *config], spark) == 0
        return [json.loads(x) for x in capsys.readouterr().out.splitlines()]

    for k, part in enumerate((calm, burst[:70], burst[70:])):
        (tmp_path / "in" / f"{k}.log").write_text("\n".join(part) + "\n")
        assert main(["stream", *config, "--checkpoint", str(tmp_path / "state"), "--once"], spark) == 0
    streamed = alerts()
    # Minutes 4 and 5 both spike; the second comes within the ten minutes of deduplication, in a later run.
    assert [(a["alert_type"], a["ts"][:19], a["trigger_value"]) for a in streamed] == [("frequency_spike", "2024-01-15T08:05:00", 1.0)]
    assert spark.read.text(str(tmp_path / "out")).count() == len(calm) + len(burst)
    (tmp_path / "feedback").write_text(json.dumps({"alert_id": streamed[0]["alert_id"], "is_false_positive": True}) + "\n")
    assert main(["anomaly", "feedback", *config], spark) == 0
    assert capsys.readouterr().out == f"frequency\t{streamed[0]['source']}\t3.1500\n"
