"""Queries over events whose numbers are those of larger tables, against their SQL."""

import collections
import datetime as dt
import json
import random
import time

import duckdb
from pyspark.sql import functions as F

from lumenlog.catalog import QUERIES, SQL
from lumenlog.operators import alerts as A
from lumenlog.operators.nested import leaves


def held(spark, folder, events, name):
    """What a query and its SQL give over events (made by SQL of DuckDB), as bags of rows."""
    duckdb.sql(f"COPY ({events}) TO '{folder}/events.parquet'")
    con = duckdb.connect()
    con.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS FROM '{folder}/events.parquet'")
    found = QUERIES[name](spark, str(folder))
    want = con.execute(SQL[name])
    names = [c[0] for c in want.description]
    return collections.Counter(map(tuple, found.select(names).collect())), collections.Counter(want.fetchall())


def test_late_patterns_of_large_ids(spark, tmp_path):
    """Code points beyond ASCII, and beyond what 256 leaves of them."""
    events = "SELECT CASE WHEN r < 1500 THEN r ELSE 150000 * (r // 1500) + r END AS event_id, (r * 7) % 1500 AS user_id, 'click' AS event_type FROM range(6000) t(r)"
    found, want = held(spark, tmp_path, events, "late_patterns")
    assert found == want and len({r[1] for r in want}) > 50


def test_release_against_all_pairs(spark):
    """Delays of several lengths, ends that are met exactly, equal times, and no source, type or time."""
    rng = random.Random(5)
    start = dt.datetime(2023, 12, 31, 23, 59, tzinfo=dt.timezone.utc)
    rows = [(k, rng.choice(["a", "b", None]), rng.choice(["x", "y", None]), None if k % 50 == 0 else start + dt.timedelta(seconds=rng.randrange(4000), microseconds=rng.choice([0, 0, 1, 999_999])), rng.choice(["delay", "delay", "suppress", "downgrade", None]), rng.choice([0, 1, 7, 60, None])) for k in range(1500)]
    judged = spark.createDataFrame(rows, "n long, source string, alert_type string, ts timestamp, action string, delay_seconds int").repartition(3)
    found = [r.n for r in A.release(judged).collect()]

    def out(n, source, kind, ts, action, delay):
        if action != "delay":
            return action != "suppress"
        if None in (source, kind, ts, delay):
            return False
        return any((s, k) == (source, kind) and t is not None and ts < t <= ts + dt.timedelta(seconds=delay) for _, s, k, t, *_ in rows)

    want = [r[0] for r in rows if out(*r)]
    assert sorted(found) == want and any(r[4] == "delay" for r in rows if r[0] in want)


def test_release_of_many_alerts_of_a_kind(spark):
    """200,000 alerts of one source and type at one time: pair by pair that is 40,000,000,000 comparisons."""
    judged = spark.range(200_000).selectExpr("id", "'s' AS source", "'k' AS alert_type", "timestamp_seconds(1700000000 + id DIV 1000000) AS ts", "'delay' AS action", "60 AS delay_seconds")
    begin = time.monotonic()
    assert A.release(judged).count() == 0 and time.monotonic() - begin < 60


def test_suppressed_alerts_of_repeated_events(spark, tmp_path):
    """Events three times, at equal times and an hour or more apart."""
    kinds = "CASE id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'purchase' ELSE 'click' END AS event_type"
    events = f"SELECT 2000 * r + id AS event_id, (id * 7) % 40 AS user_id, {kinds}, TIMESTAMP '2024-01-01' + to_seconds((id * 1201) % 90000) AS ts FROM range(2000) a(id), range(3) b(r)"
    found, want = held(spark, tmp_path, events, "alerts_suppressed")
    assert found == want and 0 < sum(r[3] == "delay" for r in want) < 1000


def walked(value, path):
    """Paths and strings of a JSON value, by its own structure."""
    if isinstance(value, str):
        yield path, value
    for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        yield from walked(v, f"{path}[{k}]" if isinstance(value, list) else f"{path}.{k}")


def test_leaves_of_many_tokens(spark):
    """20,000 lists of some 1,000 tokens, in seconds; and odd keys and strings as a walk over the values has them."""
    odd = [{"a\n\"b": ["x", {"": " ", "é😀": [[], {}, [["y\\"]], 1.5, None, True, ","]}]}, ["{", "}", ["[", ":"]], "z", {"k": {"k": {"k": "v:w"}}}, 7, {}, []]
    texts = [json.dumps(x, ensure_ascii=a, indent=i) for x in odd for a in (True, False) for i in (None, 2)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, None)], "k long, j string").select("k", leaves(F.col("j"), F.lit("r")).alias("l")).collect()
    told = {r.k: r.l for r in rows}
    assert told.pop(99) is None and {k: [tuple(x) for x in v] for k, v in told.items()} == {k: list(walked(json.loads(t), "r")) for k, t in enumerate(texts)}
    wide = spark.range(20_000).repartition(4).selectExpr("to_json(transform(sequence(1, 500), k -> IF(k % 250 = 0, concat('s', id), string(k + id)))) AS j")
    begin = time.monotonic()
    found = wide.select(F.explode(leaves(F.col("j"), F.lit("r"))).alias("l")).filter("l.path = 'r[499]'").select("l.value").distinct().count()
    assert found == 20_000 and time.monotonic() - begin < 40
