"""Replay of sanitized JSON lines as a stream, at a pace: a second of the wall clock lets in `speed` seconds of event time.

A batch job first notes, for each block of the files, the earliest and latest time in it; the stream's offset is a time, and a micro-batch reads the blocks that
hold times between two offsets, one task a block. So nothing is sorted, and nothing is read before its time but the blocks that it shares with what is
due. Records without a time come with the first micro-batch. A restarted stream paces on from the time that it had come to.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lumenlog.sources.resume import FileRange, Manifest, RangeSource, plan, ranged_lines

#: Bytes of a block.
BLOCK_BYTES = 16 << 20
_SCHEMA = "ts timestamp, level string, source string, message string, source_file string, line_no long"


def micros(text: str | None) -> int | None:
    """Microseconds of an ISO 8601 time, UTC unless it names a zone; None for anything else."""
    try:
        at = datetime.fromisoformat(text)
    except (TypeError, ValueError):
        return None
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    whole = at - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (whole.days * 86400 + whole.seconds) * 1_000_000 + whole.microseconds


def block_times(spark: SparkSession, names: Sequence[str], block: int = BLOCK_BYTES) -> list[tuple[str, int, int, int | None, int | None]]:
    """(file, first byte, size, earliest, latest time in microseconds) of each block: one pass of Spark over the lines, a row a block for the driver."""
    files, _ = plan(names, Manifest(), idle_seconds=0)
    spark.dataSource.register(RangeSource)
    rows = spark.read.format("line_ranges").option("plan", json.dumps([vars(f) for f in files])).option("split", block).load()
    at = F.unix_micros(F.try_to_timestamp(F.get_json_object("raw", "$.timestamp")))
    told = {(r.source_file, r.piece): (r.lo, r.hi) for r in rows.groupBy("source_file", "piece").agg(F.min(at).alias("lo"), F.max(at).alias("hi")).collect()}
    return [(f.path, a, f.stop, *told.get((f.name, a), (None, None))) for f in files for a in range(f.begin, f.stop, block)]


@dataclass
class Part(InputPartition):
    """The lines of a block with a time in (after, to]; with first also those without one."""

    path: str
    start: int
    stop: int
    end: int
    after: int
    to: int
    first: bool


class ReplayReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.blocks = [tuple(x) for x in json.loads(options["blocks"])]
        self.block, self.speed = int(options["block"]), float(options.get("speed", 1))
        timed = [x for x in self.blocks if x[3] is not None]
        self.low, self.high = min((x[3] for x in timed), default=0), max((x[4] for x in timed), default=0)
        self.came_to, self.begun = max(self.low - 1, int(options.get("come_to", self.low - 1))), None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": self.low - 1}

    def latestOffset(self) -> dict:  # noqa: N802
        if self.begun is None:
            self.begun = time.monotonic()
        return {"at": min(self.high, self.came_to + round((time.monotonic() - self.begun) * self.speed * 1_000_000))}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        after, to = start["at"], end["at"]
        first = after < self.low
        out = []
        for path, at, stop, lo, hi in self.blocks:
            if (lo is None and first) or (lo is not None and (first or (lo <= to and hi > after))):
                out.append(Part(path, at, min(at + self.block, stop), stop, after, to, first))
        return out

    def read(self, part: Part) -> Iterator[tuple]:
        f = FileRange(part.path, part.path, "", 0, part.end)
        for k, line in enumerate(ranged_lines(f, part.start, part.stop), 1):
            try:
                row = json.loads(line)
            except ValueError:
                continue
            if not isinstance(row, dict):
                continue
            at = micros(row.get("timestamp"))
            if (at is None and part.first) or (at is not None and part.after < at <= part.to):
                stamp = None if at is None else datetime.fromtimestamp(at // 1_000_000, timezone.utc).replace(microsecond=at % 1_000_000)
                yield stamp, row.get("level") or "UNKNOWN", row.get("source"), row.get("message"), part.path, part.start + k

    def commit(self, end: dict) -> None:
        pass


class ReplaySource(DataSource):
    """Records of sanitized JSON lines; line_no grows with the lines of a file."""

    @classmethod
    def name(cls) -> str:
        return "paced_replay"

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> ReplayReader:  # noqa: N802
        return ReplayReader(self.options)


def replay_stream(spark: SparkSession, names: Sequence[str], speed: float = 1.0, block: int = BLOCK_BYTES, checkpoint: str | None = None) -> DataFrame:
    """A stream of the records in files of sanitized JSON lines, let in by their times. checkpoint: that of the query, so that a restarted one goes on at its own time."""
    spark.dataSource.register(ReplaySource)
    reader = spark.readStream.format("paced_replay").option("blocks", json.dumps(block_times(spark, names, block))).option("block", block).option("speed", speed)
    come_to = None
    if checkpoint:
        try:
            come_to = spark.read.text(f"{checkpoint}/offsets").agg(F.max(F.get_json_object("value", "$.at").try_cast("long"))).first()[0]
        except AnalysisException:  # the query's first start
            pass
    return (reader if come_to is None else reader.option("come_to", come_to)).load()
