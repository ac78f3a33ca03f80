"""The entry without the optional subpackage, and what lines may hold."""

import datetime as dt
import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumenlog.operators import detectors as D
from lumenlog.operators import pipeline as L
from lumenlog.operators.detect import custom_rule, sanitize
from lumenlog.operators.nested import leaves
from lumenlog.operators.parse import parse_lines

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_entry_without_the_subpackage(tmp_path, also):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: {n for n in names if n in ("llm", ".git", "__pycache__", *also)})
    code = "import __spark_entry__ as e; q = e.queries(); assert 'detect_counts' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}, timeout=120)
    assert out.returncode == 0, out.stderr[-800:]


def test_an_error_inside_the_subpackage_is_told(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT / "lumenlog", copy / "lumenlog", ignore=lambda folder, names: {n for n in names if n in ("llm", "__pycache__")})
    shutil.copy(ROOT / "__spark_entry__.py", copy)
    (copy / "lumenlog" / "llm").mkdir()
    (copy / "lumenlog" / "llm" / "__init__.py").write_text("")
    (copy / "lumenlog" / "llm" / "queries.py").write_text("import lumenlog.llm.gone\n")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}, timeout=120)
    assert "lumenlog.llm.gone" in out.stderr


def test_long_strings_inside_json(spark):
    long = {"plain": "x" * 10_000_000, "escaped": '\\"\n' * 1_000_000, "mail": "a " * 2_000_000 + "u@ex.com"}
    rows = [(json.dumps({"o": {k: v}}),) for k, v in long.items()]
    found = spark.createDataFrame(rows, "j string").select(F.explode(leaves(F.col("j"), F.lit("r"))).alias("l")).select("l.path", F.length("l.value").alias("n")).collect()
    assert sorted(map(tuple, found)) == sorted((f"r.o.{k}", len(v)) for k, v in long.items())


@pytest.mark.parametrize("odd", ["\u2028", "\u2029", "\u0085", "\r", "\x01\x02"])
def test_characters_that_end_no_line(spark, odd):
    lines = [f"2024-01-15 08:30:45 [ERROR] one{odd}two", f"<34>1 2024-01-15T08:30:45Z h app 1 ID - one{odd}two", f'1.2.3.4 - - [15/Jan/2024:08:30:45 +0000] "GET /ab HTTP/1.1" 500 1 "-" "x{odd}y"', f"<131>Jan 15 08:30:45 host app[12]: one{odd}two"]
    rows = parse_lines(spark.createDataFrame([("f", k, x) for k, x in enumerate(lines)], "source_file string, line_no long, raw string"), year=2024, sticky=False).orderBy("line_no").collect()
    assert [r.fmt for r in rows] == ["plaintext", "syslog", "apache", "syslog"]
    assert [r.message for r in rows] == [f"one{odd}two", f"one{odd}two", "GET /ab HTTP/1.1", f"one{odd}two"] and rows[2].extra["user_agent"] == f"x{odd}y"


def test_year_of_the_older_syslog(spark):
    lines = spark.createDataFrame([("f", 1, "<131>Feb 29 08:30:45 host app: m"), ("f", 2, "<131>Nov 28 08:30:45 host app: m")], "source_file string, line_no long, raw string")
    stamps = lambda **k: [r.t for r in parse_lines(lines, **k).orderBy("line_no").select(F.date_format("ts", "yyyy-MM-dd").alias("t")).collect()]
    assert stamps(year=2024) == ["2024-02-29", "2024-11-28"] and stamps(year=2023) == [None, "2023-11-28"]
    assert stamps()[1][:4] == str(dt.datetime.now(dt.timezone.utc).year)


def test_custom_patterns_as_python_has_them(spark):
    rule = custom_rule("q", r"(?P<q>['\"])secret(?P=q)", strategy="replace", params={"replacement": "*"})
    assert sanitize(spark.createDataFrame([("a 'secret' b 'secret\"",)], "t string"), "t", [rule]).first().sanitized != "a 'secret' b 'secret\""
    with pytest.raises(ValueError):
        custom_rule("bad", r"(?P<a_b>x)")  # Java's group names have no underscores
    rows = parse_lines(spark.createDataFrame([("f", 1, "'x' INFO hello")], "source_file string, line_no long, raw string"), "custom", custom=r"(?P<q>')x(?P=q) (?P<level>\w+) (?P<message>.*)")
    assert (rows.first().level, rows.first().message) == ("INFO", "hello")


def test_a_source_in_two_files(spark):
    start = dt.datetime(2024, 1, 1)
    lines = [("a.log", k, "host", start + dt.timedelta(seconds=k)) for k in range(60)] + [("b.log", k, "host", start + dt.timedelta(hours=1, seconds=k)) for k in range(60)]
    rows = spark.createDataFrame([(*x, "INFO", f"m {'ab'[x[0] == 'b.log']}") for x in lines], "source_file string, line_no long, source string, ts timestamp, level string, message string").repartition(7)
    config = D.DetectorConfig(window_seconds=10, multiplier=1.5, min_samples=70)
    alerts = D.anchored_alerts(rows, config).collect()
    assert not [a for a in alerts if a.alert_type == "frequency_spike"]
    assert [tuple(r) for r in D.new_patterns(rows, 59, slot=16).collect()] == [("host", "m b", 0)] and not D.new_patterns(rows, 61, slot=16).count()


def test_bounds_of_time_are_utc(spark):
    was = spark.conf.get("spark.sql.session.timeZone")
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, 12, tzinfo=dt.timezone.utc),), (dt.datetime(2024, 1, 1, 14, tzinfo=dt.timezone.utc),)], "ts timestamp").withColumn("level", F.lit("INFO"))
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert rows.filter(L.keep(start="2024-01-01 13:00:00")).count() == 1 and rows.filter(L.keep(end="2024-01-01T13:00:00+01:00")).count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
