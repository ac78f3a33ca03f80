"""What becomes of a stream's alerts: deduplication, pairs, suppression and delays go on from micro-batch to micro-batch."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenlog.operators import alerts as A
from lumenlog.operators.detectors import ALERT, DetectorConfig
from lumenlog.streaming.keyed import keyed_alerts

JUDGED = f"{ALERT}, rule string, action string, delay_seconds int"
STATES = {"kept": "source string, alert_type string, last_at long", "waiting": ALERT, "delayed": JUDGED}


class StreamJudge:
    """Judges the detectors' alerts of each micro-batch and gives emit what goes out, and the batch's number.

    What waits lies in two slots under folder, written by turns: batch n goes on from what n - 1 left and writes the other slot, so a batch that is run again finds
    the same as before. Alerts are few, unlike records, whose state the detectors keep. A spike or a surge waits for its partner until time is that much later, and delayed alerts until one
    of their (source, type) comes, or time is past their delay. Time is the wall clock, or without one (for old files) that of the newest alert.
    """

    def __init__(self, folder: str, emit: Callable[[DataFrame, int], None], suppression: Sequence[A.Suppression] = (), dedup_seconds: int = 600, correlate_seconds: int = 30, clock: Callable[[], float] | None = time.time):
        self.folder, self.emit, self.suppression, self.clock = folder, emit, suppression, clock
        self.dedup_seconds, self.correlate_seconds, self.last = dedup_seconds, correlate_seconds, None

    def state(self, spark: SparkSession, number: int, part: str) -> DataFrame:
        """A part of what batch number - 1 left; empty before the first."""
        path = f"{self.folder}/{(number - 1) % 2}/{part}"
        try:
            return spark.read.schema(STATES[part]).parquet(path) if number else spark.createDataFrame([], STATES[part])
        except AnalysisException:  # judging began with this batch
            return spark.createDataFrame([], STATES[part])

    def __call__(self, alerts: DataFrame, number: int) -> None:
        spark, new, self.last = alerts.sparkSession, f"{self.folder}/{number % 2}", number
        before = {part: self.state(spark, number, part) for part in STATES}
        fresh = A.dedup(alerts, self.dedup_seconds, before["kept"]).persist(StorageLevel.DISK_ONLY)
        last = fresh.select("source", "alert_type", F.unix_micros("ts").alias("last_at")).unionByName(before["kept"])
        last.groupBy("source", "alert_type").agg(F.max("last_at").alias("last_at")).write.mode("overwrite").parquet(f"{new}/kept")
        paired = A.pair_up(fresh.unionByName(before["waiting"]), self.correlate_seconds).persist(StorageLevel.DISK_ONLY)
        every = paired.select("ts").unionByName(before["delayed"].select("ts"))
        now = int(self.clock() * 1e6) if self.clock else every.agg(F.max(F.unix_micros("ts"))).first()[0]
        now = F.lit(now).cast("long")
        waits = F.col("_open") & F.coalesce(F.unix_micros("ts") + self.correlate_seconds * 1_000_000 >= now, F.lit(True))
        paired.filter(waits).drop("_open").write.mode("overwrite").parquet(f"{new}/waiting")
        judged = A.apply_suppression(paired.filter(~waits).drop("_open"), self.suppression).unionByName(before["delayed"]).persist(StorageLevel.DISK_ONLY)
        out = A.release(judged)
        delayed = judged.filter("action = 'delay'").exceptAll(out.filter("action = 'delay'"))
        due = F.unix_micros("ts") + F.col("delay_seconds") * F.lit(1_000_000).cast("long")
        delayed.filter(due > now).write.mode("overwrite").parquet(f"{new}/delayed")
        self.emit(A.with_ids(out.drop("rule", "action", "delay_seconds")), number)
        for kept in (judged, paired, fresh):
            kept.unpersist()

    def flush(self, spark: SparkSession) -> None:
        """Gives out the alerts that wait for a partner, as the stream has stopped. They go under a number of their own, below 0, so doing it again writes the same."""
        if self.last is None:
            return
        waiting = self.state(spark, self.last + 1, "waiting").persist(StorageLevel.DISK_ONLY)
        self.emit(A.with_ids(A.release(A.apply_suppression(waiting, self.suppression)).drop("rule", "action", "delay_seconds")), -1 - self.last)
        waiting.unpersist()
        spark.createDataFrame([], STATES["waiting"]).write.mode("overwrite").parquet(f"{self.folder}/{self.last % 2}/waiting")


def start_alerts(records: DataFrame, config: DetectorConfig, judge: StreamJudge, checkpoint: str, once: bool = True, resets: str | None = None) -> StreamingQuery:
    """Judges what the detectors find in a stream of records, in a query of its own with its own checkpoint. resets: the folder of requests to drop a source's state."""
    writer = keyed_alerts(records, config, timed=judge.clock is not None, resets=resets).writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
