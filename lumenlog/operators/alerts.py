"""Alerts after detection: dedup, correlation, suppression, lifecycle, feedback, statistics. All in event time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions import scalars as S


def dedup(alerts: DataFrame, seconds: int = 600, last: DataFrame | None = None) -> DataFrame:
    """Drops an alert that comes within seconds of the last kept one of its (source, type): an ordered fold over that pair's times.

    The fold sees one long for each alert of a pair; alerts, unlike records, are few. last: (source, alert_type, last_at in microseconds) of alerts kept
    earlier, which the fold goes on from; an alert that isn't later than these goes.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    step = lambda at, t: F.when(at["last"].isNull() | (t - at["last"] >= seconds * 1_000_000), F.struct(t.alias("last"), F.concat(at["out"], F.array(t)).alias("out"))).otherwise(at)
    told = alerts.withColumn("last_at", F.lit(None).cast("long")) if last is None else alerts.join(last, ["source", "alert_type"], "left")
    start = F.struct(F.max("last_at").alias("last"), F.array().cast("array<bigint>").alias("out"))
    kept = told.groupBy("source", "alert_type").agg(F.aggregate(F.array_sort(F.collect_set(micros)), start, step)["out"].alias("kept")).select("source", "alert_type", F.explode("kept").alias("at"))
    first = alerts.withColumn("at", micros).withColumn("_n", F.row_number().over(Window.partitionBy("source", "alert_type", "at").orderBy("trigger_value", "description"))).filter("_n = 1").drop("_n")
    return first.join(kept, ["source", "alert_type", "at"]).select(alerts.columns)


#: Types that pair up, in the order in which they are taken at equal times.
PAIRED = ("frequency_spike", "error_rate_surge")


def pair_up(alerts: DataFrame, seconds: int = 30) -> DataFrame:
    """alerts, a composite in place of each pair, and _open: whether an alert still waits for its partner.

    A source's spikes and surges are taken in the order of time, each waiting in the slot of its type: an alert that finds its slot taken sends the one before on its own way,
    and once both slots hold alerts within seconds of each other, these become one CRITICAL composite and leave. The fold sees one number for each alert of a source;
    alerts, unlike records, are few. Equal alerts count once.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    tagged = alerts.withColumn("_t", micros).withColumn("_id", F.xxhash64(*alerts.columns)).dropDuplicates(["_id"])
    kinds = tagged.filter(F.col("alert_type").isin(*PAIRED)).withColumn("_kind", (F.col("alert_type") == PAIRED[1]).cast("int"))
    slot = "struct<t:bigint,id:bigint>"
    start = F.struct(F.lit(None).cast(slot).alias("a"), F.lit(None).cast(slot).alias("b"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("pairs"))

    def placed(at: Column, x: Column) -> Column:
        here = F.struct(x["_t"].alias("t"), x["_id"].alias("id"))
        return F.struct(F.when(x["_kind"] == 0, here).otherwise(at["a"]).alias("a"), F.when(x["_kind"] == 1, here).otherwise(at["b"]).alias("b"), at["pairs"].alias("pairs"))

    def step(at: Column, x: Column) -> Column:
        now = placed(at, x)
        met = F.coalesce(F.abs(now["a"]["t"] - now["b"]["t"]) <= seconds * 1_000_000, F.lit(False))
        left = F.struct(start["a"].alias("a"), start["b"].alias("b"), F.concat(now["pairs"], F.array(F.struct(now["a"]["id"].alias("a"), now["b"]["id"].alias("b")))).alias("pairs"))
        return F.when(met, left).otherwise(now)

    ended = kinds.groupBy("source").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("_t", "_kind", "_id"))), start, step).alias("end"))
    found = ended.select(F.explode("end.pairs").alias("p")).select(F.col("p.a").alias("_a"), F.col("p.b").alias("_b"))
    waiting = ended.select(F.explode(F.array("end.a.id", "end.b.id")).alias("_id")).filter("_id IS NOT NULL").withColumn("_open", F.lit(True))
    pairs = found.join(tagged.alias("a"), F.col("_a") == F.col("a._id")).join(tagged.alias("b"), F.col("_b") == F.col("b._id"))
    composite = {
        "ts": F.greatest("a.ts", "b.ts"), "severity": F.lit("CRITICAL"), "alert_type": F.lit("composite_anomaly"), "source": F.col("a.source"), "detector": F.lit("frequency"),
        "trigger_value": F.greatest("a.trigger_value", "b.trigger_value"), "threshold": F.least("a.threshold", "b.threshold"), "baseline_value": F.col("a.baseline_value"),
        "line_start": F.least("a.line_start", "b.line_start"), "line_end": F.greatest("a.line_end", "b.line_end"), "description": F.concat_ws("; ", "a.description", "b.description"),
    }
    made = pairs.select(*(v.alias(k) for k, v in composite.items()), F.lit(False).alias("_open"))
    used = found.select(F.explode(F.array("_a", "_b")).alias("_id"))
    alone = tagged.join(used, "_id", "left_anti").join(waiting, "_id", "left").withColumn("_open", F.coalesce("_open", F.lit(False)))
    return alone.select(*alerts.columns, "_open").unionByName(made.select(*alerts.columns, "_open"))


def correlate(alerts: DataFrame, seconds: int = 30) -> DataFrame:
    """pair_up where no more alerts come: those that wait go out on their own."""
    return pair_up(alerts, seconds).drop("_open")


@dataclass(frozen=True)
class Suppression:
    """A rule: all given conditions must hold; action suppress, downgrade or delay."""

    name: str
    action: str = "suppress"
    source_pattern: str | None = None
    alert_types: tuple[str, ...] = ()
    severities: tuple[str, ...] = ()
    cron: str | None = None
    delay_seconds: int = 0
    enabled: bool = True

    def __post_init__(self) -> None:
        if self.action not in ("suppress", "downgrade", "delay"):
            raise ValueError(f"{self.name}: unknown action {self.action}")

    def matches(self) -> Column:
        out = F.lit(True)
        if self.source_pattern:
            out = out & F.col("source").rlike(self.source_pattern)
        if self.alert_types:
            out = out & F.col("alert_type").isin(*self.alert_types)
        if self.severities:
            out = out & F.col("severity").isin(*self.severities)
        return out & S.cron_matches(self.cron, F.col("ts")) if self.cron else out


def apply_suppression(alerts: DataFrame, rules: Sequence[Suppression]) -> DataFrame:
    """alerts with rule and action of the first enabled match (null if none); downgraded ones are one level less severe."""
    rule, action, delay = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("int")
    for r in reversed([r for r in rules if r.enabled]):
        hit = r.matches()
        rule, action, delay = F.when(hit, r.name).otherwise(rule), F.when(hit, r.action).otherwise(action), F.when(hit, r.delay_seconds).otherwise(delay)
    out = alerts.withColumn("rule", rule).withColumn("action", action).withColumn("delay_seconds", delay)
    return out.withColumn("severity", F.when(F.col("action") == "downgrade", S.downgrade(F.col("severity"))).otherwise(F.col("severity")))


def with_ids(alerts: DataFrame) -> DataFrame:
    """alerts with a stable alert_id."""
    return alerts.withColumn("alert_id", F.substring(F.sha2(F.concat_ws("|", "source", "alert_type", F.unix_micros(F.col("ts").cast("timestamp")), "detector"), 256), 1, 16))


def release(judged: DataFrame) -> DataFrame:
    """What goes out: suppressed alerts don't; delayed ones do, at their end, if the same (source, type) came again in between.

    Time is cut into stretches as long as the delay. A (source, type) came again if an alert is earlier than the last of its stretch, or the first of the
    next stretch is in time: so a row for each stretch tells, and no alert meets all others of its kind.
    """
    keys, width = ["source", "alert_type", "delay_seconds", "_stretch"], F.col("delay_seconds").cast("long") * 1_000_000
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    stretch = F.col("_at") - F.pmod(F.col("_at"), width)
    delayed = judged.filter("action = 'delay' AND delay_seconds > 0").withColumn("_at", micros).withColumn("_stretch", stretch)
    delays = delayed.select("delay_seconds").distinct()
    seen = judged.filter("ts IS NOT NULL").select("source", "alert_type", micros.alias("_at")).crossJoin(F.broadcast(delays)).withColumn("_stretch", stretch)
    seen = seen.groupBy(*keys).agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    # The first of a stretch is told to the one before.
    told = F.explode(F.array(F.struct("_stretch", "_last", F.lit(None).cast("long").alias("_next")), F.struct((F.col("_stretch") - width).alias("_stretch"), F.lit(None).cast("long").alias("_last"), F.col("_first").alias("_next"))))
    told = seen.select(*keys[:3], told.alias("t")).groupBy(*keys[:3], F.col("t._stretch").alias("_stretch")).agg(F.max("t._last").alias("_last"), F.max("t._next").alias("_next"))
    again = (F.col("_last") > F.col("_at")) | (F.col("_next") <= F.col("_at") + width)
    kept = delayed.join(told, keys).filter(again).select(judged.columns)
    return judged.filter("action IS NULL OR action = 'downgrade'").unionByName(kept)


def suppression_hits(judged: DataFrame) -> DataFrame:
    """How often and when last each rule matched."""
    return judged.filter("rule IS NOT NULL").groupBy("rule").agg(F.count("*").alias("hit_count"), F.max("ts").alias("last_hit"))


def lifecycle(alerts: DataFrame, feedback: DataFrame, newest_resolved: int = 100) -> DataFrame:
    """alerts (alert_id) with status after feedback (alert_id, action, at): acknowledge, resolve, reopen in order. Only the newest resolved stay."""
    steps = feedback.filter("action IN ('acknowledge', 'resolve', 'reopen')").groupBy("alert_id").agg(F.array_sort(F.collect_list(F.struct("at", "action"))).alias("steps"))
    move = lambda s, x: F.when(x["action"] == "reopen", "active").when(x["action"] == "resolve", "resolved").when(s == "active", "acknowledged").otherwise(s)
    out = alerts.join(steps, "alert_id", "left").withColumn("status", F.coalesce(F.aggregate("steps", F.lit("active"), move), F.lit("active")))
    out = out.withColumn("_last", F.try_element_at("steps", F.lit(-1))["at"]).drop("steps")
    top = out.filter("status = 'resolved'").orderBy(F.desc("_last"), "alert_id").limit(newest_resolved)
    return out.filter("status <> 'resolved'").unionByName(top).drop("_last")


def resolutions(alerts: DataFrame, feedback: DataFrame) -> DataFrame:
    """Each time that feedback in order resolved an alert which wasn't resolved before: alerts with old_status, new_status, and nth (from 1 for each alert)."""
    steps = feedback.filter("action IN ('acknowledge', 'resolve', 'reopen')").select("alert_id", "at", "action")
    order = Window.partitionBy("alert_id").orderBy("at", "action")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    n = F.row_number().over(order)
    turn = F.col("action") != "acknowledge"
    last = lambda hit, what: F.last(F.when(hit, what), ignorenulls=True).over(before)
    told = steps.withColumn("_n", n).select("*", last(turn, F.col("action")).alias("_turn"), last(turn, F.col("_n")).alias("_turned"), last(~turn, F.col("_n")).alias("_seen"))
    told = told.filter((F.col("action") == "resolve") & ~F.col("_turn").eqNullSafe("resolve"))
    old = F.when(F.col("_seen") > F.coalesce("_turned", F.lit(0)), "acknowledged").otherwise("active")
    told = told.select("alert_id", old.alias("old_status"), F.lit("resolved").alias("new_status"), n.alias("nth"))
    return alerts.join(told, "alert_id")


def tuned_thresholds(feedback: DataFrame, alerts: DataFrame, initial: float = 3.0, by_detector: Mapping[str, float] | None = None) -> DataFrame:
    """detector, source, threshold after ordered feedback: a false positive raises it by 5 % up to 3 times the initial one, a true one lowers it by 2 % down to 0.3 times.
    The initial one is that of the detector, else initial."""
    first = F.coalesce(*(F.when(F.col("detector") == d, F.lit(float(v))) for d, v in (by_detector or {}).items()), F.lit(float(initial)))
    step = lambda t, x: F.when(x["fp"], F.least(t * 1.05, 3 * first)).otherwise(F.greatest(t * 0.98, 0.3 * first))
    told = feedback.filter("is_false_positive IS NOT NULL").join(alerts.select("alert_id", "detector", "source"), "alert_id").filter("detector IN ('frequency', 'error_rate')")
    marks = F.array_sort(F.collect_list(F.struct("at", F.col("is_false_positive").alias("fp"))))
    return told.groupBy("detector", "source").agg(F.aggregate(marks, first, step).alias("threshold"))


def alert_stats(alerts: DataFrame) -> DataFrame:
    """Counts by severity, type, source, detector and in all, as (dimension, value, n)."""
    dims = ("severity", "alert_type", "source", "detector")
    pairs = F.array(F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")), *(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims))
    return alerts.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def listing(alerts: DataFrame, status: str | None = None, source_pattern: str | None = None, order: str = "timestamp") -> DataFrame:
    """Alerts filtered and sorted by timestamp (newest first), severity (worst first) or source."""
    if status and "status" in alerts.columns:
        alerts = alerts.filter(F.col("status") == status)
    if source_pattern:
        alerts = alerts.filter(F.col("source").rlike(source_pattern))
    rank = F.when(F.col("severity") == "CRITICAL", 3).when(F.col("severity") == "WARNING", 2).otherwise(1)
    return alerts.orderBy({"timestamp": F.desc("ts"), "severity": rank.desc(), "source": F.asc("source")}[order])
