"""Anomaly detectors over parsed records: frequency spikes, error-rate surges, new and vanished message patterns.

Anchored mode follows each source's own windows: one opens at the first record's time and closes with the record that comes window
seconds later or more, which opens the next. It is sequential in a source by definition; records are dealt out by source and sorted
inside partitions, and a fold with fixed memory for each source streams over them. Grid mode has windows on a fixed grid and is native.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions import scalars as S

ALERT = "ts timestamp, severity string, alert_type string, source string, detector string, trigger_value double, threshold double, baseline_value double, line_start long, line_end long, description string"


DETECTORS = ("frequency", "error_rate", "pattern")


@dataclass(frozen=True)
class DetectorConfig:
    window_seconds: float = 60.0
    windows: Mapping[str, float] = field(default_factory=dict)  # detector -> seconds, where it isn't window_seconds
    alpha: float = 0.3
    multiplier: float = 3.0
    history: int = 20
    z_threshold: float = 2.5
    min_samples: int = 100
    disappear_windows: int = 3
    overrides: Mapping[tuple[str, str], float] = field(default_factory=dict)  # (detector, source) -> threshold
    weights: Mapping[str, float] = field(default_factory=dict)  # source -> weight

    def seconds(self, detector: str) -> float:
        return self.windows.get(detector, self.window_seconds)

    def threshold(self, detector: str, source: str) -> float:
        return self.overrides.get((detector, source), self.multiplier if detector == "frequency" else self.z_threshold)


def _z(values: list[float], x: float) -> float:
    mid = lambda v: (lambda s, n: s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2)(sorted(v), len(v))
    if not values:
        return 0.0
    med = mid(values)
    mad = mid([abs(v - med) for v in values])
    return (x - med) / (1.4826 * mad) if mad else (0.0 if x == med else float("inf"))


class SourceState:
    """One source's windows, statistics and known templates. Each detector has its own window; those of the same size move together.

    frozen() and SourceState.thawed give and take the state as plain values, for storing it between runs or micro-batches.
    """

    FIELDS = ("ewma", "seen", "last", "rates", "known", "absent", "window_templates", "start", "first", "count", "errors")

    def __init__(self, source: str, config: DetectorConfig):
        self.source, self.c = source, config
        self.ewma: float | None = None
        self.seen = self.last = 0
        self.rates: list[float] = []
        self.known: dict[str, int] = {}
        self.absent: dict[str, int] = {}
        self.window_templates: set[str] = set()
        self.start: dict[str, float | None] = dict.fromkeys(DETECTORS)  # seconds since the epoch
        self.first, self.count, self.errors = (dict.fromkeys(DETECTORS, 0) for _ in range(3))

    def frozen(self) -> dict:
        return {k: sorted(v) if isinstance(v, set) else v for k in self.FIELDS for v in (getattr(self, k),)}

    @classmethod
    def thawed(cls, source: str, config: DetectorConfig, told: Mapping) -> SourceState:
        state = cls(source, config)
        for k in cls.FIELDS:
            setattr(state, k, set(told[k]) if k == "window_templates" else told[k])
        return state

    def alert(self, at, severity, kind, detector, value, threshold, baseline, text):
        weight = self.c.weights.get(self.source, 1.0)
        severity = "INFO" if weight < 0.5 else "WARNING" if weight < 0.8 and severity == "CRITICAL" else severity
        return (pd.Timestamp(round(at * 1e6), unit="us"), severity, kind, self.source, detector, float(value), float(threshold), float(baseline), self.first[detector], self.last, text)

    def close(self, at: float, detectors: tuple[str, ...] = DETECTORS, forced: bool = True) -> Iterator[tuple]:
        """Judges the open windows of some detectors at a time (seconds); forced where no record closes them, as at the end of the input: then no window is open."""
        for d in detectors:
            if self.start[d] is None or not self.count[d]:
                continue
            yield from getattr(self, f"_{d}")(at)
            self.count[d] = self.errors[d] = 0
            if d == "pattern":
                self.window_templates = set()
            if forced:
                self.start[d] = None

    def _frequency(self, at: float) -> Iterator[tuple]:
        frequency, k = self.count["frequency"] / self.c.seconds("frequency"), self.c.threshold("frequency", self.source)
        if self.ewma is not None and frequency > self.ewma * k:
            yield self.alert(at, "WARNING", "frequency_spike", "frequency", frequency, self.ewma * k, self.ewma, f"{frequency:.4f} records a second")
        self.ewma = frequency if self.ewma is None else self.c.alpha * frequency + (1 - self.c.alpha) * self.ewma

    def _error_rate(self, at: float) -> Iterator[tuple]:
        rate, k = self.errors["error_rate"] / self.count["error_rate"], self.c.threshold("error_rate", self.source)
        if self.rates and (z := _z(self.rates, rate)) > k:
            yield self.alert(at, "WARNING", "error_rate_surge", "error_rate", rate, k, sorted(self.rates)[len(self.rates) // 2], f"error rate {rate:.4f}, z {z:.2f}")
        self.rates = [*self.rates, rate][-self.c.history :]

    def _pattern(self, at: float) -> Iterator[tuple]:
        for template in sorted(self.known):
            if template in self.window_templates:
                self.absent.pop(template, None)
            elif (n := self.absent.get(template, 0) + 1) >= self.c.disappear_windows:
                self.absent.pop(template, None)
                yield self.alert(at, "INFO", "pattern_disappeared", "pattern", n, self.c.disappear_windows, self.known[template], f"not seen: {template}")
            else:
                self.absent[template] = n

    def add(self, at: float, level: str, template: str, line_no: int) -> Iterator[tuple]:
        # The record that closes a window counts in the next; its template counts in the one that it closes.
        for d in DETECTORS:
            if self.start[d] is not None and at - self.start[d] >= self.c.seconds(d):
                if d == "pattern":
                    self.window_templates.add(template)
                yield from self.close(at, (d,), forced=False)
                self.start[d], self.first[d] = at, line_no
            elif self.start[d] is None:
                self.start[d], self.first[d] = at, line_no
            self.count[d] += 1
            self.errors[d] += level in ("ERROR", "WARN")
        self.last = line_no
        self.seen += 1
        if template not in self.known and self.seen > self.c.min_samples:
            yield self.alert(at, "WARNING", "new_pattern", "pattern", 1, self.c.min_samples, 0, f"new: {template}")
        self.known[template] = self.known.get(template, 0) + 1
        self.window_templates.add(template)


def templated_records(records: DataFrame) -> DataFrame:
    """source, ts, level, template, line_no, file (where records name it) of the records that have a time."""
    file = F.col("source_file") if "source_file" in records.columns else F.lit(None).cast("string")
    return records.filter("ts IS NOT NULL").select("source", F.col("ts").cast("timestamp").alias("ts"), "level", S.templatize(F.col("message")).alias("template"), F.col("line_no").cast("long").alias("line_no"), file.alias("file"))


def anchored_alerts(records: DataFrame, config: DetectorConfig | None = None, states: DataFrame | None = None, save: bool = False, finish: bool = True, idle_since: float | None = None, by_time: bool = False) -> DataFrame:
    """Alerts of all detectors in event time. records: source, ts, level, message, line_no; rows without a time are passed over.

    A source's last window closes at its last record, or without finish stays open in the state, and records come in the order of time. Else, unless by_time, a source's records come file by file, in the order of lines. Templates of a source are kept as long as the fold runs. states: (source, state) of an
    earlier run to go on from, as save returns them besides the alerts: rows with state, all else null. idle_since (seconds of the wall clock): windows of a state
    whose end is not after it, of sources without new records, close at their end.
    """
    config = config or DetectorConfig()
    names = [c.split()[0] for c in ALERT.split(", ")] + ["state"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, last, out = None, None, []

        def ended() -> list[tuple]:
            if state is None:
                return []
            rows = [(*a, None) for a in state.close(last)] if last is not None and finish else []
            if last is None and idle_since is not None:
                rows = [(*a, None) for d in DETECTORS if state.start[d] is not None and (end := state.start[d] + config.seconds(d)) <= idle_since for a in state.close(end, (d,))]
            told = (None, None, None, state.source, *[None] * 7, json.dumps(state.frozen(), sort_keys=True))
            return [*rows, told] if save else rows

        for pdf in batches:
            for source, ts, level, template, line, _, told in pdf.itertuples(index=False):
                if state is None or state.source != source:
                    out += ended()
                    state, last = SourceState(source, config), None
                if told is not None:
                    state = SourceState.thawed(source, config, json.loads(told))
                    continue
                last = ts.value / 1e9
                out += [(*a, None) for a in state.add(last, level, template, line)]
            yield _alert_rows(out, names)
            out = []
        yield _alert_rows(ended(), names)

    dealt = templated_records(records).withColumn("state", F.lit(None).cast("string"))
    if states is not None:
        dealt = dealt.unionByName(states.select("source", F.lit(-1).cast("long").alias("line_no"), "state"), allowMissingColumns=True)
    out = dealt.repartition("source").sortWithinPartitions("source", F.col("state").isNull(), *(["ts", "file", "line_no"] if by_time or not finish else ["file", "line_no"])).mapInPandas(fold, f"{ALERT}, state string")
    return out if save else out.drop("state")


def _alert_rows(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"ts": "datetime64[us]", "line_start": "Int64", "line_end": "Int64"})


def grid_windows(records: DataFrame, seconds: int = 3600) -> DataFrame:
    """source, w (start of the window), n, errors, rate, on a fixed grid; empty windows don't come."""
    w = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000)) * seconds).alias("w")
    return records.groupBy("source", w).agg(F.count("*").alias("n"), F.count_if(F.col("level").isin("ERROR", "WARN")).alias("errors")).withColumn("rate", F.col("errors") / F.col("n"))


def _history() -> Column:
    return F.array_sort(F.collect_list(F.struct("w", "n", "rate")))


def frequency_spikes(windows: DataFrame, seconds: int = 3600, alpha: float = 0.3, multiplier: float = 3.0) -> DataFrame:
    """source, w, frequency, baseline (the EWMA before the window), spike. A source's history is one row for each of its windows."""
    f = lambda x: x["n"] / F.lit(float(seconds))
    step = lambda at, x: F.struct(F.when(at["e"].isNull(), f(x)).otherwise(alpha * f(x) + (1 - alpha) * at["e"]).alias("e"), F.concat(at["out"], F.array(F.struct(x["w"].alias("w"), f(x).alias("frequency"), at["e"].alias("baseline")))).alias("out"))
    start = F.struct(F.lit(None).cast("double").alias("e"), F.array().cast("array<struct<w:bigint,frequency:double,baseline:double>>").alias("out"))
    return windows.groupBy("source").agg(F.explode(F.aggregate(_history(), start, step)["out"]).alias("x")).select("source", "x.*", F.coalesce(F.col("x.frequency") > F.col("x.baseline") * multiplier, F.lit(False)).alias("spike"))


def error_surges(windows: DataFrame, k: int = 20, z: float = 2.5) -> DataFrame:
    """source, w, rate, z (against the last k windows before; null for the first), surge."""
    before = Window.partitionBy("source").orderBy("w").rowsBetween(-k, -1)
    past = F.collect_list("rate").over(before)
    scored = windows.withColumn("past", past).withColumn("z", F.when(F.size("past") > 0, S.modified_z(F.col("past"), F.col("rate"))))
    return scored.select("source", "w", "rate", S.finite(F.col("z")).alias("z"), F.coalesce(F.col("z") > z, F.lit(False)).alias("surge"))


def new_patterns(records: DataFrame, min_samples: int = 100, slot: int = 1 << 20) -> DataFrame:
    """source, template, line_no of templates that first come once a source has min_samples lines behind it, file by file (of source_file, where records have it).

    How many lines come before a template's first one is told by the counts of the slots of line numbers before, and the lines of its own slot; so
    no task numbers all lines of a source.
    """
    file = F.col("source_file") if "source_file" in records.columns else F.lit("")
    at = F.struct(file.alias("file"), F.floor(F.col("line_no") / slot).alias("slot")).alias("slot")
    lines = records.select("source", F.struct(file.alias("file"), "line_no").alias("line"), at, S.templatize(F.col("message")).alias("template"))
    first = lines.groupBy("source", "template").agg(F.min("line").alias("line"))
    counts = lines.groupBy("source", "slot").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("skipped", F.coalesce(F.sum("n").over(before), F.lit(0))).filter((F.col("skipped") <= min_samples) & (F.col("skipped") + F.col("n") > min_samples))
    # Of the slot where a source passes min_samples, lines are counted one by one: which is its line number min_samples.
    near = lines.select("source", "line", "slot").join(counts.select("source", "slot", "skipped"), ["source", "slot"])
    nth = F.row_number().over(Window.partitionBy("source").orderBy("line")) + F.col("skipped")
    bound = near.withColumn("nth", nth).filter(F.col("nth") == min_samples + 1).select("source", F.col("line").alias("from_line"))
    return first.join(bound, "source").filter(F.col("line") >= F.col("from_line")).select("source", "template", "line.line_no")
