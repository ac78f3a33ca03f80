"""The tailing source: appended lines, held-back ends, rotation, truncation, watch lists and splits."""

import json
import os

import pytest

from lumenlog.sources import tail
from lumenlog.sources.tail import TailReader, TailSource


def step(reader, start):
    end = reader.latestOffset()
    return [raw for p in reader.partitions(start, end) for _, _, raw in reader.read(p)], end


def test_reader(tmp_path):
    path = tmp_path / "a.log"
    path.write_text("old\n")
    r = TailReader({"paths": str(path), "max_line_length": "5"})
    at = r.initialOffset()
    path.open("a").write("one\r\ntwo")
    rows, at = step(r, at)
    assert rows == ["one"]  # the last line waits for its end
    path.open("a").write("\n1234567\n")
    rows, at = step(r, at)
    assert rows == ["two", "12345"]
    path.write_text("new\n")  # truncated
    rows, at = step(r, at)
    assert rows == ["new"]
    other = tmp_path / "b"
    other.write_text("rotated\nmore lines than there were\n")
    os.replace(other, path)
    rows, at = step(r, at)
    assert rows == ["rotat", "more "]
    os.remove(path)
    rows, at = step(r, at)
    assert rows == []
    path.write_text("back\n")
    assert step(r, at)[0] == ["back"]
    with pytest.raises(ValueError):
        TailReader({})


def test_splits(tmp_path, monkeypatch):
    path = tmp_path / "a.log"
    lines = [f"line {k} " + "x" * (k % 23) for k in range(200)]
    path.write_text("\n".join(lines) + "\n")
    for size in (1, 7, 64, 10_000):
        monkeypatch.setattr(tail, "SPLIT_BYTES", size)
        monkeypatch.setattr(tail, "BLOCK", size)
        r = TailReader({"paths": str(path), "from_start": "true"})
        assert step(r, r.initialOffset())[0] == lines


def test_watch_list(tmp_path):
    a, b, watch = tmp_path / "a", tmp_path / "b", tmp_path / "watch.json"
    a.write_text("")
    b.write_text("before\n")
    watch.write_text(json.dumps([str(a)]))
    r = TailReader({"watch": str(watch)})
    at = r.initialOffset()
    watch.write_text(json.dumps([str(a), {"path": str(b)}]))
    os.utime(watch, ns=(1, 1))
    rows, at = step(r, at)
    assert rows == [] and set(at) == {str(a), str(b)}
    b.open("a").write("after\n")
    watch.write_text("no list")
    os.utime(watch, ns=(2, 2))
    assert step(r, at)[0] == ["after"]


def test_stream(spark, tmp_path):
    path = tmp_path / "a.log"
    path.write_text("one\ntwo\n")
    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("line_tail").option("paths", str(path)).option("from_start", "true").load()

    def more():
        query = lines.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()
        return sorted(r.raw for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert more() == ["one", "two"]
    path.open("a").write("three\n")
    assert more() == ["one", "three", "two"]
