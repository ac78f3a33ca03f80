"""Anchored windows of any source over all tasks: the alerts of detectors.anchored_alerts without taking a source's records one by one.

A window opens at a record and closes with the first later one that is a window's length or more after it. So every record that opens a window is later in time than all
before it in the source's order, and among these leading records order and time agree. The next opening after a time is then a search in sorted
times. Times are cut into blocks of FAN windows; a task makes of a block the map from the time at which a window may open to the time from which the next one
opens behind the block, for the few entries that this can depend on; FAN blocks then make one of the next level. Walking down again from the one
entry at the top tells the entry of each block, and at last all openings. A source's busy hours lie in many blocks, and no task sees more than one.

What a record's place in its source needs (how many before it, the latest time before it, how many openings up to it) are sums and maxima over range
partitions and, inside these, windows. Everything after that is an aggregate by window; only a source's windows, one row each, are judged in order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.operators.detectors import ALERT, DetectorConfig, _z, templated_records
from lumenlog.storage import discard, settle

#: Windows of a block, and blocks of one of the next level.
FAN = 64
_START = np.iinfo(np.int64).min
_STEPS = "source string, block long, entry long, exit long"


def in_order(records: DataFrame) -> DataFrame:
    """source, us (microseconds), level, template, line_no, part, nth: a source's records by part, then nth, in the order of file and line, settled."""
    rows = templated_records(records).select("source", F.col("file"), "line_no", F.unix_micros("ts").alias("us"), "level", "template")
    order = ["source", "file", "line_no", "us", "template"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return settle(ranged.select("source", "us", "level", "template", "line_no", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("nth")), "ordered")


def running(rows: DataFrame, total: Callable[[Column], Column], value: Column, name: str, whole: bool) -> DataFrame:
    """rows with a sum or maximum over all rows of the source before (with whole: up to) each."""
    parts = rows.groupBy("source", "part").agg(total(value).alias("_here"))
    before = total(F.col("_here")).over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("source").alias("_source"), F.col("part").alias("_part"), before.alias("_before"))
    inside = total(value).over(Window.partitionBy("source", "part").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0 if whole else -1))
    told = rows.withColumn("_inside", inside).join(parts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part")))
    return told.withColumn(name, total_of(total, F.col("_before"), F.col("_inside"))).drop("_source", "_part", "_before", "_inside")


def total_of(total: Callable[[Column], Column], a: Column, b: Column) -> Column:
    if total is F.max:
        return F.greatest(a, b)
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def block_steps(times: np.ndarray, width: int, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the sorted leading times of a block that begins at a time: those that a window from before can make an opening, and for each the time from which the
    next window behind the block opens."""
    n = len(times)
    after = np.append(np.searchsorted(times, times + width), n)
    last, jump = np.append(np.arange(n), n), after
    while (jump[:n] < n).any():  # last: the opening so far; jump: the one that many further
        last = np.where(jump < n, last[np.minimum(jump, n)], last)
        jump = jump[jump]
    entries = np.arange(min(int(np.searchsorted(times, begin + width)) + 1, n))
    return times[entries], times[last[entries]] + width


def openings(times: np.ndarray, width: int, entry: int) -> np.ndarray:
    """The times of a block that open windows, if they are entered from a time on."""
    out, at = [], int(np.searchsorted(times, entry))
    while at < len(times):
        out.append(at)
        at = int(np.searchsorted(times, times[at] + width))
    return times[out]


def through(pdf: pd.DataFrame, x: np.ndarray, each: Callable[[int, np.ndarray], None] | None = None) -> np.ndarray:
    """Times x carried through the blocks of a group, in order; each sees a block and the times as they come to it."""
    for block, steps in pdf.sort_values(["block", "entry"]).groupby("block", sort=True):
        if each:
            each(block, x)
        entry, out = steps["entry"].to_numpy(), steps["exit"].to_numpy()
        at = np.searchsorted(entry, x)
        x = np.where(at < len(entry), out[np.minimum(at, len(entry) - 1)], x)
    return x


def window_starts(nodes: DataFrame, width: int) -> DataFrame:
    """source, us of the leading records (source, us) that open windows of width microseconds, settled."""
    blocked = settle(nodes.select("source", "us", F.expr(f"us div {width * FAN}").alias("block")), "nodes")

    def lowest(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        entry, out = block_steps(np.sort(pdf["us"].to_numpy()), width, block * width * FAN)
        return pd.DataFrame({"source": pdf["source"].iloc[0], "block": block, "entry": entry, "exit": out})

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["block", "entry"])
        first = rows["block"].iloc[0] if rows["block"].iloc[0] % FAN == 0 else None
        own = rows.loc[rows["block"] == first, "entry"].to_numpy()
        later = rows.loc[rows["block"] != first, "entry"].to_numpy()[:1]
        entry = np.concatenate([own, later]).astype(np.int64)
        return pd.DataFrame({"source": rows["source"].iloc[0], "block": int(rows["block"].iloc[0]) // FAN, "entry": entry, "exit": through(rows, entry)})

    def entered(pdf: pd.DataFrame) -> pd.DataFrame:
        told: list[tuple[int, int]] = []
        through(pdf, pdf["x"].iloc[:1].to_numpy(), lambda block, x: told.append((int(block), int(x[0]))))
        return pd.DataFrame(told, columns=["block", "x"]).assign(source=pdf["source"].iloc[0])[["source", "block", "x"]]

    levels = [settle(blocked.groupBy("source", "block").applyInPandas(lowest, _STEPS), "steps")]
    while levels[-1].groupBy("source").agg(F.countDistinct("block").alias("n")).filter("n > 1").limit(1).count():
        up = F.floor(F.col("block") / FAN)
        levels.append(settle(levels[-1].groupBy("source", up.alias("above")).applyInPandas(merged, _STEPS), "steps"))
    at = levels[-1].select("source", "block").distinct().withColumn("x", F.lit(int(_START)))
    for level in reversed(levels[:-1]):
        told = at.select(F.col("source").alias("_source"), F.col("block").alias("above"), "x")
        own = level.withColumn("_above", F.floor(F.col("block") / FAN)).join(told, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_above") == F.col("above")))
        at = settle(own.groupBy("source", "above").applyInPandas(entered, "source string, block long, x long"), "entered")

    def opened(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"source": pdf["source"].iloc[0], "us": openings(np.sort(pdf["us"].to_numpy()), width, int(pdf["x"].iloc[0]))})

    told = at.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "x")
    starts = settle(blocked.join(told, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))).groupBy("source", "block").applyInPandas(opened, "source string, us long"), "starts")
    discard(blocked, *levels)
    return starts


def windowed(rows: DataFrame, width: int) -> DataFrame:
    """rows (source, us, part, nth, leads) with opens and k, the number of the window that a record is in, from 1."""
    starts = window_starts(rows.filter("leads").select("source", "us"), width).select(F.col("source").alias("_source"), F.col("us").alias("_us"), F.lit(1).alias("_opens"))
    marked = rows.join(starts, F.col("leads") & F.col("source").eqNullSafe(F.col("_source")) & (F.col("us") == F.col("_us")), "left")
    marked = marked.withColumn("opens", F.coalesce("_opens", F.lit(0))).drop("_source", "_us", "_opens")
    return running(marked, F.sum, F.col("opens"), "k", whole=True)


def window_table(rows: DataFrame) -> DataFrame:
    """source, k, n, errors, line_start, line_end, at (when the window closes: with the record that opens the next, the last with the last record)."""
    order = F.struct("part", "nth")
    w = rows.groupBy("source", "k").agg(F.count("*").alias("n"), F.count_if(F.col("level").isin("ERROR", "WARN")).alias("errors"), F.min_by("line_no", order).alias("line_start"), F.max_by("line_no", order).alias("line_end"), F.min_by("us", order).alias("_first"), F.max_by("us", order).alias("_last"))
    closes = F.coalesce(F.lead("_first").over(Window.partitionBy("source").orderBy("k")), F.col("_last"))
    return w.withColumn("at", closes).drop("_first", "_last")


def judged_windows(config: DetectorConfig, detector: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For applyInPandas over a source's windows: its frequency spikes or error-rate surges."""

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        source, out, before, past = pdf["source"].iloc[0], [], None, []
        limit = config.threshold(detector, source)
        for w in pdf.sort_values("k").itertuples():
            if detector == "frequency":
                f = w.n / config.seconds(detector)
                if before is not None and f > before * limit:
                    out.append((w.at, "frequency_spike", f, before * limit, before, w.line_start, w.line_end, f"{f:.4f} records a second"))
                before = f if before is None else config.alpha * f + (1 - config.alpha) * before
            else:
                rate = w.errors / w.n
                if past and (z := _z(past, rate)) > limit:
                    out.append((w.at, "error_rate_surge", rate, limit, sorted(past)[len(past) // 2], w.line_start, w.line_end, f"error rate {rate:.4f}, z {z:.2f}"))
                past = [*past, rate][-config.history :]
        columns = ["at", "alert_type", "trigger_value", "threshold", "baseline_value", "line_start", "line_end", "description"]
        return pd.DataFrame(out, columns=columns).assign(source=source)[["source", *columns]]

    return judge


def _patterns(rows: DataFrame, table: DataFrame, config: DetectorConfig) -> DataFrame:
    """New and vanished templates. A record that opens a window counts, as its template goes, in the one that it closes too."""
    named = running(rows.withColumn("_one", F.lit(1)), F.sum, F.col("_one"), "place", whole=True).drop("_one")
    first = named.groupBy("source", "template").agg(F.min(F.struct("place", "us", "line_no", "k")).alias("f")).filter(F.col("f.place") > config.min_samples)
    w = table.select(F.col("source").alias("_source"), F.col("k").alias("_k"), "at", "line_start", "line_end")
    on = lambda k: F.col("source").eqNullSafe(F.col("_source")) & (k == F.col("_k"))
    value = lambda v: F.lit(v).cast("double")
    new = first.join(w, on(F.col("f.k"))).select("source", F.col("f.us").alias("at"), F.lit("new_pattern").alias("alert_type"), value(1).alias("trigger_value"), value(config.min_samples).alias("threshold"), value(0).alias("baseline_value"), "line_start", F.col("f.line_no").alias("line_end"), F.concat(F.lit("new: "), "template").alias("description"))
    counts = rows.groupBy("source", "template", "k").agg(F.count("*").alias("n"), F.max("opens").alias("opens"), F.sum("opens").alias("_starts"))
    seen = counts.select("source", "template", F.explode(F.when(F.col("opens") > 0, F.array(F.col("k") - 1, F.col("k"))).otherwise(F.array("k"))).alias("k"), F.lit(0).cast("long").alias("n")).filter("k > 0")
    seen = seen.unionByName(counts.select("source", "template", "k", "n")).groupBy("source", "template", "k").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("source", "template").orderBy("k")
    ends = table.groupBy("source").agg(F.max("k").alias("_top")).withColumnRenamed("source", "_of")
    gaps = seen.withColumn("known", F.sum("n").over(by)).withColumn("next", F.lead("k").over(by)).filter("known > 0").join(ends, F.col("source").eqNullSafe(F.col("_of")))
    # A record that opens the next window is in known only from there on, as it is in the windows' own counts.
    least = config.disappear_windows
    until = F.coalesce(F.col("next") - 1, F.col("_top"))
    gone = gaps.filter(until - F.col("k") >= least).select("source", "template", "known", F.explode(F.sequence(F.col("k") + least, until, F.lit(least).cast("long"))).alias("k"))
    lost = gone.join(w, on(F.col("k"))).select("source", "at", F.lit("pattern_disappeared").alias("alert_type"), value(least).alias("trigger_value"), value(least).alias("threshold"), F.col("known").cast("double").alias("baseline_value"), "line_start", "line_end", F.concat(F.lit("not seen: "), "template").alias("description"))
    return new.unionByName(lost)


def spread_alerts(records: DataFrame, config: DetectorConfig | None = None) -> DataFrame:
    """The alerts of all detectors in anchored windows, over a source's records file by file in the order of lines, as anchored_alerts without a state gives them."""
    config = config or DetectorConfig()
    ordered = in_order(records)
    rows = running(ordered, F.max, F.col("us"), "_latest", whole=False)
    rows = settle(rows.withColumn("leads", F.coalesce(F.col("us") > F.col("_latest"), F.lit(True))).drop("_latest"), "leading")
    discard(ordered)
    parts, done = [], {}
    for detector in ("frequency", "error_rate", "pattern"):
        width = round(config.seconds(detector) * 1_000_000)
        if width not in done:
            inside = settle(windowed(rows, width), "windowed")
            done[width] = inside, settle(window_table(inside), "windows")
        inside, table = done[width]
        if detector == "pattern":
            parts.append(_patterns(inside, table, config).withColumn("detector", F.lit(detector)))
        else:
            schema = "source string, at long, alert_type string, trigger_value double, threshold double, baseline_value double, line_start long, line_end long, description string"
            parts.append(table.groupBy("source").applyInPandas(judged_windows(config, detector), schema).withColumn("detector", F.lit(detector)))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    severity = F.when(F.col("alert_type") == "pattern_disappeared", "INFO").otherwise("WARNING")
    if light := [s for s, v in config.weights.items() if v < 0.5]:
        severity = F.when(F.col("source").isin(*light), "INFO").otherwise(severity)
    out = every.withColumn("ts", F.timestamp_micros("at")).withColumn("severity", severity)
    return settle(out.select([c.split()[0] for c in ALERT.split(", ")]), "alerts")
