"""Runs that go on from earlier ones, filters and counts, nested values, encodings, pipes, detector state."""

import datetime as dt
import json

from pyspark.sql import functions as F

from lumenlog import cli
from lumenlog.config import parse_settings
from lumenlog.operators import alerts as A
from lumenlog.operators import detectors as D
from lumenlog.operators.nested import field_path, leaves
from lumenlog.sources.text import read_lines
from lumenlog.streaming.judge import StreamJudge


def settings(folder, **more):
    return parse_settings({"inputs": {"paths": [str(folder / "in")]}, "output": {"file": str(folder / "out")}, "state_file": str(folder / "state"), **more})


def test_filters_counts_and_going_on(spark, tmp_path):
    (tmp_path / "in").mkdir()
    log = tmp_path / "in" / "a.log"
    log.write_text("2024-01-15 08:30:45 [ERROR] from 10.0.0.1\n2024-01-15 08:30:46 [INFO] from 10.0.0.2\njunk\n")
    s = settings(tmp_path, parser={"format": "plaintext"}, filters={"levels": ["ERROR"]})
    totals = cli.run(spark, s)
    assert (totals["total_lines"], totals["parsed_lines"], totals["unparsed_lines"], totals["total_fields"], totals["sanitized_fields"]) == (3, 2, 1, 1, 1)
    written = lambda: sorted(json.loads(r.value)["message"] for r in spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "out")).collect())
    assert written() == ["from 10.0.*.*", "junk"]
    assert not cli.run(spark, s)["total_lines"] and written() == ["from 10.0.*.*", "junk"]  # the file is done
    with log.open("a") as f:
        f.write("2024-01-15 08:30:47 [ERROR] more from 10.0.0.3\n")
    (tmp_path / "in" / "b.log").write_text("2024-01-15 08:30:45 [ERROR] other\n")
    assert cli.run(spark, s)["total_lines"] == 2 and written() == ["from 10.0.*.*", "junk", "more from 10.0.*.*", "other"]
    log.write_text("2024-01-15 08:30:47 [ERROR] anew\n")
    assert cli.run(spark, s)["total_lines"] == 1 and "anew" in written()


def test_no_inputs(spark, tmp_path, capsys):
    config = tmp_path / "c.yaml"
    config.write_text(f"inputs: {{paths: ['{tmp_path}/none']}}\noutput: {{stdout: true}}\n")
    assert cli.main(["run", "-c", str(config)], spark) == 1 and "no input files" in capsys.readouterr().err


def test_encodings(spark, tmp_path):
    (tmp_path / "l.log").write_bytes("größe\nzwei\n".encode("latin-1"))
    (tmp_path / "u.log").write_bytes(b"a\xffb\n")
    assert [r.raw for r in read_lines(spark, str(tmp_path / "l.log"), encoding="latin-1").orderBy("line_no").collect()] == ["größe", "zwei"]
    assert read_lines(spark, str(tmp_path / "u.log")).first().raw == "a\ufffdb"


def test_nested_paths(spark):
    text = json.dumps({"a": {"b": [{"c": "x"}, ["y", {"d": "z"}], 5]}, "e\"f": "q\\", "g": []})
    row = spark.createDataFrame([(text,)], "j string").select(leaves(F.col("j"), F.lit("extra")).alias("l"), field_path(F.lit("a.b[0][1].c")).alias("p")).first()
    assert [tuple(x) for x in row.l] == [("extra.a.b[0].c", "x"), ("extra.a.b[1][0]", "y"), ("extra.a.b[1][1].d", "z"), ('extra.e"f', "q\\")]
    assert row.p == ["a", "b", "[0]", "[1]", "c"]


def test_pipe(spark, tmp_path):
    s = settings(tmp_path, stream={"route_rules": [{"level_match": "ERROR", "output_target": str(tmp_path / "errors")}]})
    lines = ["2024-01-15 08:30:45 [ERROR] from 10.0.0.1", "2024-01-15 08:30:46 [INFO] ok", "2024-01-15 08:30:46 [INFO] three"]
    assert cli.pipe(spark, s, lines, rows=2) == 3
    assert [json.loads(r.value)["message"] for r in spark.read.text(str(tmp_path / "errors")).collect()] == ["from 10.0.*.*"] and spark.read.text(str(tmp_path / "out")).count() == 2


def test_detectors_go_on_from_a_stored_state(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("s", start + dt.timedelta(seconds=0.5 * k if k < 40 else 20 + 0.01 * (k - 40)), "ERROR" if k % 17 == 0 else "INFO", f"m {'abc'[k % 3]}" if k < 90 else "late", k) for k in range(120)]
    frame = lambda part: spark.createDataFrame(part, "source string, ts timestamp, level string, message string, line_no long")
    config = D.DetectorConfig(window_seconds=2, windows={"pattern": 5.0}, multiplier=1.5, min_samples=50)
    whole = sorted(map(str, D.anchored_alerts(frame(rows), config).collect()))
    first = D.anchored_alerts(frame(rows[:30]), config, save=True).collect()
    state = spark.createDataFrame([(r.source, r.state) for r in first if r.state], "source string, state string")
    second = D.anchored_alerts(frame(rows[30:]), config, states=state, save=True).collect()
    kinds = {r.alert_type for r in second if r.state is None}
    assert "new_pattern" in kinds and any("new_pattern" in x for x in whole) and json.loads(next(r.state for r in second if r.state))["seen"] == 120


def test_stream_judge(spark, tmp_path):
    """Pairs meet over batches, delayed alerts wait for their repetition, and a batch run again gives the same."""
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    at = lambda t: start + dt.timedelta(seconds=t)
    frame = lambda rows: spark.createDataFrame([(at(t), "WARNING", kind, x, "frequency", 2.0, 1.0, 1.0, 1, 2, f"d{t}") for x, t, kind in rows], D.ALERT)
    got: dict[int, list] = {}
    emit = lambda alerts, n: got.__setitem__(n, sorted((r.source, r.alert_type, int(r.ts.timestamp() - start.timestamp())) for r in alerts.collect()))
    clock = [at(30).timestamp()]
    rule = A.Suppression("wait", "delay", source_pattern="slow", delay_seconds=100)
    judge = StreamJudge(str(tmp_path / "state"), emit, (rule,), dedup_seconds=5, correlate_seconds=30, clock=lambda: clock[0])
    judge(frame([("a", 20, "frequency_spike"), ("slow", 21, "new_pattern"), ("b", 22, "frequency_spike"), ("b", 24, "frequency_spike")]), 0)
    assert got[0] == []  # a and b wait for a surge, slow is delayed; b's second comes too soon
    judge(frame([("a", 40, "error_rate_surge"), ("c", 41, "new_pattern")]), 1)
    assert got[1] == [("a", "composite_anomaly", 40), ("c", "new_pattern", 41)]
    clock[0] = at(60).timestamp()
    for _ in range(2):
        judge(frame([("slow", 50, "new_pattern"), ("a", 55, "error_rate_surge")]), 2)
        assert got[2] == [("b", "frequency_spike", 22), ("slow", "new_pattern", 21)]  # nobody came for b; slow came again within 100 seconds
    clock[0] = at(300).timestamp()
    judge(frame([]), 3)
    assert got[3] == [("a", "error_rate_surge", 55)]  # slow's second was alone until its delay was over


def test_thresholds_and_windows_of_detectors():
    s = parse_settings({"inputs": {"paths": "x"}, "output": {"stdout": True}, "anomaly_detection": {"algorithms": {"frequency": {"threshold_multiplier": "auto", "window_size_seconds": 60, "initial_threshold_multiplier": 4}, "error_rate": {"z_score_threshold": {"default": "auto", "db": 5}, "window_size_seconds": 120}}}})
    d = s.detectors
    assert (d.threshold("frequency", "x"), d.threshold("error_rate", "x"), d.threshold("error_rate", "db")) == (4.0, 2.5, 5.0) and (d.seconds("frequency"), d.seconds("error_rate"), d.seconds("pattern")) == (60, 120, 300)


def test_status_and_reset(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("".join(f"2024-01-15 08:{k:02d}:45 [ERROR] from {k}\n" for k in range(30)))
    config = tmp_path / "c.yaml"
    config.write_text(f"inputs: {{paths: ['{tmp_path}/in']}}\noutput: {{file: '{tmp_path}/out'}}\nstate_file: '{tmp_path}/state'\nanomaly_detection: {{enabled: true, alert_file: '{tmp_path}/alerts'}}\n")
    assert cli.main(["run", "-c", str(config)], spark) == 0
    capsys.readouterr()
    assert cli.main(["anomaly", "status", "-c", str(config)], spark) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["seen"] == 30 and told["templates"] == 1
    assert cli.main(["anomaly", "reset", told["source"], "-c", str(config)], spark) == 0 and cli.main(["anomaly", "status", "-c", str(config)], spark) == 0
    assert capsys.readouterr().out.strip() == ""
    assert cli.main(["detect", "--file", str(tmp_path / "out")], spark) == 0
