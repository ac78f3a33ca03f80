"""Detectors of a stream as keyed state: each source has its windows in a value, its templates in a map, and a timer for the end of its open windows.

A micro-batch touches only sources that have records or whose timer is due, and writes only the templates that changed; Spark keeps the state with the stream's
checkpoint, so a restarted stream goes on where it was. A source's records of a micro-batch come in the order of time, then file and line. With timers a window of a
source that sends nothing more closes once the wall clock is past its end; without (for old files) windows close by later records alone.

A source is reset by a row of a second stream, a folder that ask_reset writes to: its state is dropped before the records of the micro-batch in which the row comes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenlog.operators.detectors import ALERT, DETECTORS, DetectorConfig, SourceState, templated_records

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NAMES = [c.split()[0] for c in ALERT.split(", ")]
#: What of a SourceState lies in the value; the rest is by template.
_CORE = ("ewma", "seen", "last", "rates", "start", "first", "count", "errors")


class KeyedDetectors(StatefulProcessor):
    """Takes templated records by source and gives alerts."""

    def __init__(self, config: DetectorConfig, timed: bool):
        self.config, self.timed = config, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.core = handle.getValueState("core", "told string")
        self.templates = handle.getMapState("templates", "template string", "n long, absent int, here boolean")

    def _load(self, source: str) -> tuple[SourceState, dict[str, tuple]]:
        state, held = SourceState(source, self.config), {}
        if self.core.exists():
            for k, v in json.loads(self.core.get()[0]).items():
                setattr(state, k, v)
            held = {k[0]: tuple(v) for k, v in self.templates.iterator()}
            state.known = {k: v[0] for k, v in held.items() if v[0]}
            state.absent = {k: v[1] for k, v in held.items() if v[1]}
            state.window_templates = {k for k, v in held.items() if v[2]}
        return state, held

    def _store(self, state: SourceState, held: dict[str, tuple]) -> None:
        self.core.update((json.dumps({k: getattr(state, k) for k in _CORE}),))
        for k in {*state.known, *state.window_templates}:
            if (now := (state.known.get(k, 0), state.absent.get(k, 0), k in state.window_templates)) != held.get(k):
                self.templates.updateValue((k,), now)
        ends = [at + self.config.seconds(d) for d, at in state.start.items() if at is not None and state.count[d]]
        if self.timed:
            for told in list(self.handle.listTimers()):
                self.handle.deleteTimer(told)
            if ends:
                self.handle.registerTimer(int(min(ends) * 1000) + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        whole = pd.concat(list(rows), ignore_index=True)
        if (reset := whole["reset"].astype(bool)).any():
            self.core.clear()
            self.templates.clear()
            for told in list(self.handle.listTimers()) if self.timed else ():
                self.handle.deleteTimer(told)
            whole = whole[~reset]
            if whole.empty:
                return
        state, held = self._load(key[0])
        whole = whole.sort_values(["ts", "file", "line_no"], kind="stable")
        out = [a for ts, level, template, line in zip(whole["ts"], whole["level"], whole["template"], whole["line_no"], strict=True) for a in state.add(ts.value / 1e9, level, template, int(line))]
        self._store(state, held)
        if out:
            yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, held = self._load(key[0])
        now = timerValues.getCurrentProcessingTimeInMs() / 1000
        due = [(state.start[d] + self.config.seconds(d), d) for d in DETECTORS if state.start[d] is not None and state.start[d] + self.config.seconds(d) <= now]
        out = [a for end, d in due for a in state.close(end, (d,))]
        self._store(state, held)
        if out:
            yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES).astype({"ts": "datetime64[us]", "line_start": "int64", "line_end": "int64"})


def ask_reset(spark: SparkSession, folder: str, source: str | None = None) -> None:
    """Has the stream that reads folder drop a source's state; without a source folder is made if it isn't there."""
    spark.createDataFrame([] if source is None else [(source,)], "source string").coalesce(1).write.mode("append").json(folder)


def keyed_alerts(records: DataFrame, config: DetectorConfig, timed: bool = True, resets: str | None = None) -> DataFrame:
    """The alerts of a stream of records (source, ts, level, message, line_no and, where there is one, source_file). resets: a folder that ask_reset writes to."""
    records.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = templated_records(records).withColumn("source", F.coalesce("source", F.lit(""))).withColumn("reset", F.lit(False))
    if resets:
        ask_reset(records.sparkSession, resets)
        asked = records.sparkSession.readStream.schema("source string").json(resets).filter("source IS NOT NULL").withColumn("reset", F.lit(True))
        rows = rows.unionByName(asked, allowMissingColumns=True)
    return rows.groupBy("source").transformWithStateInPandas(KeyedDetectors(config, timed), ALERT, "append", "processingTime" if timed else "none")


def stream_status(spark: SparkSession, checkpoint: str) -> list[dict]:
    """The stored state of each source, read from the checkpoint of a stream's alerts: windows, statistics, how many templates it knows."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    n = state("templates").groupBy(F.col("key.source").alias("source")).agg(F.count_if(F.col("user_map_value.n") > 0).alias("templates"), F.count_if(F.col("user_map_value.absent") > 0).alias("absent"))
    rows = state("core").select(F.col("key.source").alias("source"), "value.told").join(n, "source", "left").orderBy("source")
    out = []
    for row in rows.toLocalIterator():
        told = json.loads(row.told)
        out.append({"source": row.source, "seen": told["seen"], "ewma": told["ewma"], "rates": len(told["rates"]), "templates": row.templates or 0, "absent": row.absent or 0})
    return out
