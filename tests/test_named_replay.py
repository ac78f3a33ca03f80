"""Files with names of their own, paced replay, counters of a stream, JSON of many parts."""

import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F
from test_keyed import told

from lumenlog.operators import detectors as D
from lumenlog.operators import pipeline as L
from lumenlog.operators.detect import BUILTIN
from lumenlog.operators.nested import leaves
from lumenlog.sources.named import write_named
from lumenlog.sources.replay import replay_stream
from lumenlog.streaming.keyed import keyed_alerts
from lumenlog.streaming.live import parsed_records, start_routed, stream_counts, stream_lines
from lumenlog.streaming.notify import Metrics

START = dt.datetime(2024, 1, 15, 8)


def test_named_files(spark, tmp_path):
    rows = [(START + dt.timedelta(hours=9 * k), json.dumps({"k": k, "ä": [k]}, ensure_ascii=False)) for k in range(6)] + [(None, '{"k":-1}')]
    frame = spark.createDataFrame(rows, "ts timestamp, json string").repartition(3)
    folder = tmp_path / "out"
    write_named(frame.coalesce(1), str(folder), "log_{date}.jsonl", "day")
    assert {x: len((folder / x).read_text().splitlines()) for x in os.listdir(folder)} == {"log_2024-01-15.jsonl": 2, "log_2024-01-16.jsonl": 3, "log_2024-01-17.jsonl": 1, "log.jsonl": 1}
    write_named(frame.coalesce(1), str(folder), "log_{date}.jsonl", "day", overwrite=True)
    assert len(os.listdir(folder)) == 4
    write_named(frame, str(folder), "log_{date}.jsonl", "day")
    assert sum(len((folder / x).read_text().splitlines()) for x in os.listdir(folder)) == 14 and "log_2024-01-16-1.jsonl" in os.listdir(folder)
    write_named(frame.filter("ts IS NOT NULL").coalesce(1), str(tmp_path / "hours"), "x.json", "hour", pretty=True)
    assert sorted(os.listdir(tmp_path / "hours"))[0] == "x_2024-01-15_08.json" and json.loads((tmp_path / "hours" / "x_2024-01-15_08.json").read_text()) == {"k": 0, "ä": [0]}


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    bad = spark.createDataFrame([(START, "{}"), (START, "no json")], "ts timestamp, json string").repartition(2)
    with pytest.raises(Exception, match="(?i)json|expecting"):
        write_named(bad, str(tmp_path / "out"), "a.json", pretty=True)
    assert not (tmp_path / "out").exists() or os.listdir(tmp_path / "out") == []


def test_paced_replay(spark, tmp_path):
    rows = []
    for k in range(400):
        at = START + dt.timedelta(seconds=(k * 0.5 if k < 200 else 100 + (k - 200) * (0.05 if k < 300 else 0.5)))
        rows.append((f"s{k % 2}", "f", k, at, "ERROR" if k % 40 > 30 else "INFO", f"m {'xy'[k > 250]} {k}"))
    order = sorted(rows, key=lambda r: r[2] % 7)  # not in the order of time
    (tmp_path / "in.jsonl").write_text("".join(json.dumps({"timestamp": r[3].isoformat() + "+00:00", "level": r[4], "source": r[0], "message": r[5], "extra": {}}) + "\n" for r in order) + "no json\n")
    config = D.DetectorConfig(window_seconds=10.0, multiplier=1.3, z_threshold=1.2, min_samples=50)
    stream = replay_stream(spark, [str(tmp_path / "in.jsonl")], speed=10, block=4096)
    alerts, seen = [], []
    span = max(r[3] for r in rows) - START
    begun = time.monotonic()
    pace = stream.writeStream.foreachBatch(lambda df, n: seen.append((time.monotonic() - begun, df.agg(F.count("*"), F.max("ts")).first()))).option("checkpointLocation", str(tmp_path / "cp1")).trigger(processingTime="200 milliseconds").start()
    found = keyed_alerts(stream, config, False).writeStream.foreachBatch(lambda df, n: alerts.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp2")).trigger(processingTime="1 second").start()
    until = time.monotonic() + 70
    while time.monotonic() < until and sum(r[0] for _, r in seen) < 400:
        time.sleep(0.3)
    took = time.monotonic() - begun
    time.sleep(12)
    pace.stop()
    found.stop()
    assert sum(r[0] for _, r in seen) == 400 and len([1 for _, r in seen if r[0]]) > 5
    assert took >= span.total_seconds() / 10 * 0.9
    frame = spark.createDataFrame(rows, "source string, source_file string, line_no long, ts timestamp, level string, message string")
    last = dict(frame.groupBy("source").agg(F.max("ts")).collect())
    batch = [r for r in D.anchored_alerts(frame, config, by_time=True).collect() if not (r.ts == last[r.source] and r.alert_type != "new_pattern")]
    strip = lambda rows: [(*x[:7], *x[9:]) for x in told(rows)]
    assert sorted(strip(alerts)) == sorted(strip(batch)) and batch


def test_a_restarted_replay_goes_on(spark, tmp_path):
    """Of ten seconds of records each comes once, though the stream stops in between."""
    (tmp_path / "in.jsonl").write_text("".join(json.dumps({"timestamp": (START + dt.timedelta(seconds=k / 10)).isoformat(), "level": "INFO", "source": "s", "message": f"m {k}"}) + "\n" for k in range(200)))
    seen = []
    for seconds in (6, 40):
        stream = replay_stream(spark, [str(tmp_path / "in.jsonl")], speed=2, block=1 << 12, checkpoint=str(tmp_path / "cp"))
        query = stream.writeStream.foreachBatch(lambda df, n: seen.extend(r.message for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
        until = time.monotonic() + seconds
        while time.monotonic() < until and len(seen) < 200:
            time.sleep(0.3)
        query.stop()
        assert seconds == 40 or 0 < len(seen) < 200
    assert sorted(seen) == sorted(f"m {k}" for k in range(200))


def test_counts_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.log").write_text("".join(json.dumps({"timestamp": f"2024-01-15T08:{j:02d}:00Z", "level": "ERROR" if j % 3 == 0 else "INFO", "source": f"s{j % 2}", "message": f"from 10.0.0.{j} u{k}@ex.com"}) + "\n" for j in range(10)) + "junk\n")
    listener = Metrics(str(tmp_path / "metrics"))
    spark.streams.addListener(listener)
    try:
        records = parsed_records(stream_lines(spark, str(tmp_path / "in"), files_per_trigger=1), "json")
        start_routed(records, (), str(tmp_path / "out"), str(tmp_path / "cp"), rules=lambda: BUILTIN).awaitTermination()
        for _ in range(50):
            if (tmp_path / "metrics").exists() and len((tmp_path / "metrics").read_text().splitlines()) >= 3:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    metrics = [json.loads(x) for x in (tmp_path / "metrics").read_text().splitlines()]
    assert sum(m["lines"] for m in metrics) == 33 == metrics[-1]["total_lines"] and sum(m["errors"] for m in metrics) == 12
    got = {(r.source, r.kind): r.n for r in stream_counts(spark, str(tmp_path / "cp")).collect()}
    assert got["s0", "lines"] == got["s1", "lines"] == 15 and got["s0", "found:email"] == 15 and got["s0", "found:ipv4"] == 15 and got["s1", "error_rate"] == 0.4
    batch = L.sanitize_records(parsed_records(spark.read.text(str(tmp_path / "in")).select(F.lit("f").alias("source_file"), F.lit(0).cast("long").alias("line_no"), F.col("value").alias("raw")), "json"))
    totals = L.file_stats(batch).first()
    kind = lambda k: sum(n for (_, what), n in got.items() if what == k)
    assert (kind("lines"), kind("parsed"), kind("fields"), kind("sanitized")) == (totals.total_lines, totals.parsed_lines, totals.total_fields, totals.sanitized_fields)


def test_json_of_many_parts(spark):
    wide = json.dumps({"a": [{"k": f"v{k}"} for k in range(8000)]})
    deep = '{"d":' * 60 + '"end"' + "}" * 60
    began = time.monotonic()
    rows = spark.createDataFrame([(wide,), (deep,), ("{}",), ('["x"]',)], "j string").select(leaves(F.col("j"), F.lit("r")).alias("l")).collect()
    assert time.monotonic() - began < 60
    assert [len(r.l) for r in rows] == [8000, 1, 0, 1] and rows[0].l[7999] == ("r.a[7999].k", "v7999") and rows[1].l[0] == ("r" + ".d" * 60, "end") and rows[3].l[0] == ("r[0]", "x")
