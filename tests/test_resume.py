"""Runs over growing files: appended and half lines, rotation, crashes, wide encodings split at every byte."""

import json
import os

import pytest

from lumenlog import cli
from lumenlog.config import parse_settings
from lumenlog.sources import resume as R
from lumenlog.sources.text import read_lines


def settings(folder, **more):
    return parse_settings({"inputs": {"paths": [str(folder / "in")]}, "output": {"file": str(folder / "out")}, "state_file": str(folder / "state"), "parser": {"format": "plaintext"}, **more})


def written(spark, folder):
    rows = spark.read.option("recursiveFileLookup", "true").text(str(folder / "out")).collect()
    return sorted(json.loads(r.value)["message"] for r in rows)


@pytest.fixture
def log(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path / "in" / "a.log"


def test_half_line_waits(spark, tmp_path, log):
    log.write_text("one\ntwo par")
    s = settings(tmp_path)
    assert cli.run(spark, s)["total_lines"] == 1 and written(spark, tmp_path) == ["one"]
    with log.open("a") as f:
        f.write("tial done\nthree\n")
    totals = cli.run(spark, s)
    assert totals["total_lines"] == 2 and written(spark, tmp_path) == ["one", "three", "two partial done"]
    assert cli.run(spark, s)["skipped_files"] == 1
    with log.open("a") as f:
        f.write("last without an end")
    os.utime(log, (1, 1))  # nobody has written to it for long
    assert cli.run(spark, s)["total_lines"] == 1 and "last without an end" in written(spark, tmp_path)


def test_rotation(spark, tmp_path, log):
    s = settings(tmp_path)
    log.write_text("a1\na2\n")
    cli.run(spark, s)
    log.rename(tmp_path / "in" / "a.log.1")  # larger, and the old file is still read
    log.write_text("b1\nb2\nb3 which is longer\n")
    assert cli.run(spark, s)["total_lines"] == 3
    log.rename(tmp_path / "in" / "a.log.2")
    log.write_text("c1\nc2\nc3 which is longer\n")  # of the same size
    with (tmp_path / "in" / "a.log.2").open("a") as f:
        f.write("b4, late\n")
    assert cli.run(spark, s)["total_lines"] == 4
    log.write_text("d1\n")  # the same inode, begun anew, shorter
    assert cli.run(spark, s)["total_lines"] == 1
    with log.open("r+") as f:  # the same inode, other text of more bytes
        f.write("e1\ne2\ne3\n")
    assert cli.run(spark, s)["total_lines"] == 3
    assert written(spark, tmp_path) == sorted(["a1", "a2", "b1", "b2", "b3 which is longer", "b4, late", "c1", "c2", "c3 which is longer", "d1", "e1", "e2", "e3"])


def test_crash_between_output_and_commit(spark, tmp_path, log, monkeypatch):
    s = settings(tmp_path, audit_log={"enabled": True, "file": str(tmp_path / "audit")}, anomaly_detection={"enabled": True, "alert_file": str(tmp_path / "alerts")})
    log.write_text("2024-01-15 08:30:45 [ERROR] from 10.0.0.1\n")
    cli.run(spark, s)
    with log.open("a") as f:
        f.write("2024-01-15 08:30:46 [ERROR] from 10.0.0.2\n")

    def dies(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(cli, "put_manifest", dies)
        with pytest.raises(OSError):
            cli.run(spark, s)
    with log.open("a") as f:
        f.write("2024-01-15 08:30:47 [ERROR] from 10.0.0.3\n")
    assert cli.run(spark, s)["total_lines"] == 2
    assert len(written(spark, tmp_path)) == 3 and len(set(spark.read.option("recursiveFileLookup", "true").json(str(tmp_path / "audit")).select("line_number").collect())) == 3
    assert spark.read.option("recursiveFileLookup", "true").json(str(tmp_path / "audit")).count() == 3
    assert cli.detector_status(spark, s)[0]["seen"] == 3


def test_two_runs_at_once(spark, tmp_path):
    R.put_manifest(spark, str(tmp_path), R.Manifest(1, {}))
    with pytest.raises(RuntimeError):
        R.put_manifest(spark, str(tmp_path), R.Manifest(1, {"x": {}}))
    assert R.newest(spark, str(tmp_path)) == R.Manifest(1, {}) and R.newest(spark, str(tmp_path / "none")).number == 0


TEXTS = ["", "a", "\n", "one\ntwo\r\n\nthree", "äਊੁ䄊ਊ\nb\n\u000a\U0001f600\nend\n", "x" * 50 + "\n" + "਀" * 9]


@pytest.mark.parametrize("encoding", ["utf-8", "latin-1", "utf-16", "utf-16-le", "utf-16-be", "utf-32", "utf_32_be", "utf-32-le"])
def test_every_border(tmp_path, encoding):
    """Every split of small files gives Python's lines, and every count its number of lines."""
    for k, text in enumerate(TEXTS):
        text = text.encode(encoding, "ignore").decode(encoding)
        path = tmp_path / f"{k}.log"
        path.write_bytes(text.encode(encoding))
        codec, mark = R.codec_of(str(path), encoding)
        unit, end = R.WIDE.get(codec, (1, b"\n"))
        f = R.FileRange("n", str(path), "i", mark, path.stat().st_size, 0, codec)
        want = text.split("\n")
        want = want if want[-1] else want[:-1]
        for split in range(unit, f.stop + unit + 1, unit):
            pieces = [(a, min(a + split, f.stop)) for a in range(f.begin, f.stop, split)]
            lines = [[x.decode(codec) for x in R.ranged_lines(f, a, b)] for a, b in pieces]
            assert [x.removesuffix("\n") for part in lines for x in part] == want
            if unit == 1:
                assert [len(x) for x in lines] == [R.count_ends(f, a, b) for a, b in pieces]
        assert R.last_end(str(path), f.stop, unit, end) == (len((text[: text.rindex("\n") + 1]).encode(encoding)) if "\n" in text else 0)


def test_wide_files(spark, tmp_path):
    text = "".join(f"2024-01-15 08:30:45 [INFO] größe ਊ {k}\r\n" for k in range(3000))
    for encoding in ("utf-16", "utf-32-be"):
        (tmp_path / f"{encoding}.log").write_bytes(text.encode(encoding))
        rows = read_lines(spark, str(tmp_path / f"{encoding}.log"), encoding=encoding).orderBy("line_no").collect()
        assert [r.raw for r in rows] == text.split("\r\n")[:-1] and [r.line_no for r in rows] == list(range(1, 3001))
    names = [f"file://{tmp_path}/utf-16.log"]
    lines, counts = R.read_ranges(spark, R.plan(names, R.Manifest(), "utf-16")[0], split=1024)
    assert counts == {names[0]: 3000} and [r.raw for r in lines.orderBy("line_no").collect()] == text.split("\r\n")[:-1]


def test_reports_of_files(spark, tmp_path, log):
    s = settings(tmp_path, report_json=str(tmp_path / "r.json"), report_file=str(tmp_path / "r.txt"))
    log.write_text("2024-01-15 08:30:45 [ERROR] from 10.0.0.1\njunk\n")
    cli.run(spark, s)
    (tmp_path / "in" / "b.log").write_text("2024-01-15 08:30:45 [INFO] a@b.cd c@d.ef\n")
    cli.run(spark, s)
    told = json.loads((tmp_path / "r.json").read_text())
    assert told["summary"]["skipped_files"] == 1 and [x.endswith("a.log") for x in told["skipped"]] == [True] and told["summary"]["lines_per_second"] > 0
    assert [(f["source_file"][-5:], f["total_lines"], f["sanitized_fields"], f["detections"]) for f in told["files"]] == [("b.log", 1, 1, {"email": 2})]
    assert "  email=2" in (tmp_path / "r.txt").read_text().splitlines()
