"""The detectors of a stream against the batch query: restarts, idle sources, stored state."""

import datetime as dt
import json
import time

import numpy as np
from pyspark.sql import functions as F

from lumenlog.operators import detectors as D
from lumenlog.streaming.keyed import ask_reset, keyed_alerts, stream_status

SCHEMA = "source string, source_file string, line_no long, ts timestamp, level string, message string"


def told(rows, stamp=True):
    return sorted((r.source, r.alert_type, r.ts if stamp else None, r.severity, round(r.trigger_value, 9), round(r.threshold, 9), round(r.baseline_value, 9), r.line_start, r.line_end, r.description) for r in rows)


def write(folder, number, rows):
    folder.mkdir(exist_ok=True)
    text = "".join(json.dumps({"source": s, "source_file": f, "line_no": n, "ts": ts.strftime("%Y-%m-%dT%H:%M:%S.%fZ"), "level": level, "message": m}) + "\n" for s, f, n, ts, level, m in rows)
    (folder / f"{number}.json").write_text(text)


def rows_of(start, n=240, seed=3, step=0.5):
    rng, out = np.random.default_rng(seed), []
    for source, gap in (("a", step), ("b", step * 2)):
        at = 0.0
        for k in range(n):
            at += float(rng.exponential(gap * (0.1 if k % 60 > 45 else 1)))
            kind = "xy"[int(rng.integers(0, 2))] if k < n // 2 else "xz"[int(rng.integers(0, 2))]
            out.append((source, "f", k, start + dt.timedelta(microseconds=round(at * 1e6)), "ERROR" if k % 60 > 50 else "INFO", f"m {kind} {k}"))
    return sorted(out, key=lambda r: r[3])


def run(spark, folder, config, timed, seconds=0, got=None, resets=None):
    got = [] if got is None else got
    stream = keyed_alerts(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder / "in")), config, timed, resets)
    writer = stream.writeStream.foreachBatch(lambda df, n: got.extend(df.collect())).option("checkpointLocation", str(folder / "cp"))
    query = (writer.trigger(processingTime="1 second") if seconds else writer.trigger(availableNow=True)).start()
    if seconds:
        end = time.time() + seconds
        while time.time() < end and query.isActive:
            time.sleep(0.5)
        query.stop()
    query.awaitTermination()
    return got


def test_restarts(spark, tmp_path):
    rows = rows_of(dt.datetime(2024, 1, 1))
    config = D.DetectorConfig(window_seconds=10.0, windows={"pattern": 15.0}, multiplier=1.3, z_threshold=1.2, min_samples=50, disappear_windows=2)
    got = []
    for number, part in enumerate((rows[:130], rows[130:300], rows[300:])):
        write(tmp_path / "in", number, part)
        run(spark, tmp_path, config, False, got=got)
    frame = spark.createDataFrame(rows, SCHEMA)
    last = dict(frame.groupBy("source").agg(F.max("ts")).collect())
    batch = [r for r in D.anchored_alerts(frame, config, by_time=True).collect()]
    closed_at_the_end = [r for r in batch if r.ts == last[r.source] and r.alert_type != "new_pattern"]
    assert told(got) == told([r for r in batch if r not in closed_at_the_end]) and {r.alert_type for r in got} == {"frequency_spike", "error_rate_surge", "new_pattern", "pattern_disappeared"}
    status = stream_status(spark, str(tmp_path / "cp"))
    assert [(r["source"], r["seen"], r["templates"]) for r in status] == [tuple(r) for r in frame.groupBy("source").agg(F.count("*"), F.countDistinct(F.regexp_extract("message", "m .", 0))).orderBy("source").collect()]


def test_a_source_is_reset(spark, tmp_path):
    """After a reset a source is judged as one that begins with what comes next; the others go on. A reset of a source that is not there changes nothing."""
    rows, resets = rows_of(dt.datetime(2024, 1, 1)), str(tmp_path / "resets")
    config = D.DetectorConfig(window_seconds=10.0, windows={"pattern": 15.0}, multiplier=1.3, z_threshold=1.2, min_samples=50, disappear_windows=2)
    early, late = rows[:240], rows[240:]
    write(tmp_path / "in", 0, early)
    got = run(spark, tmp_path, config, False, resets=resets)
    ask_reset(spark, resets, "a")
    ask_reset(spark, resets, "none")
    run(spark, tmp_path, config, False, got=got, resets=resets)
    assert [r["source"] for r in stream_status(spark, str(tmp_path / "cp"))] == ["b"]
    write(tmp_path / "in", 1, late)
    run(spark, tmp_path, config, False, got=got, resets=resets)
    want = []
    for part in ([r for r in early if r[0] == "a"], [r for r in late if r[0] == "a"], [r for r in rows if r[0] == "b"]):
        last = max(r[3] for r in part)
        want += [r for r in D.anchored_alerts(spark.createDataFrame(part, SCHEMA), config, by_time=True).collect() if r.ts != last or r.alert_type == "new_pattern"]
    assert told(got) == told(want) and {r["source"]: r["seen"] for r in stream_status(spark, str(tmp_path / "cp"))} == {"a": sum(r[0] == "a" for r in late), "b": 240}


def test_idle_sources_close_by_the_clock(spark, tmp_path):
    start = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) - dt.timedelta(seconds=60)
    rows = rows_of(start, n=80, step=0.25)
    config = D.DetectorConfig(window_seconds=5.0, multiplier=1.3, z_threshold=1.2, min_samples=50, disappear_windows=2)
    write(tmp_path / "in", 0, rows)
    got = run(spark, tmp_path, config, True, seconds=25)
    assert told(got, stamp=False) == told(D.anchored_alerts(spark.createDataFrame(rows, SCHEMA), config, by_time=True).collect(), stamp=False)
