"""Growing text files as a stream: a Python data source whose offsets are bytes by file, so that only appended whole lines are read.

    spark.dataSource.register(TailSource)
    spark.readStream.format("line_tail").option("paths", "/logs/a.log,/logs/b.log").load()

Options: paths (comma list) or watch (a JSON list of paths or {"path": ...}, read again when it changes; an unreadable list keeps the
last one), from_start (false: only what comes after the start), max_line_length (longer lines are cut, as the 64 KiB limit of a tail asks).

A file with a new inode or fewer bytes than read is read from its start; a last line without its end waits. Files must be visible to the
driver and the executors by the same path. Bytes that are no UTF-8 are replaced. A file that is missing is read from its start once it comes.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of one task; a longer piece of a file is split.
SPLIT_BYTES = 64 << 20
BLOCK = 1 << 16


@dataclass
class Piece(InputPartition):
    """Lines of path that start in [start, stop); begin: where the batch starts reading the file."""

    path: str
    begin: int
    start: int
    stop: int


def whole_lines(path: str, size: int) -> int:
    """The byte after the last line end in the first size bytes; 0 if there is none."""
    with open(path, "rb") as f:
        while size > 0:
            low = max(0, size - BLOCK)
            f.seek(low)
            at = f.read(size - low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            size = low
    return 0


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.fixed = [p.strip() for p in options.get("paths", "").split(",") if p.strip()]
        self.watch, self.watched, self.seen = options.get("watch"), [], None
        self.from_start = options.get("from_start", "false").lower() == "true"
        self.limit = int(options.get("max_line_length", 65536))
        if not self.fixed and not self.watch:
            raise ValueError("paths or watch must be given")

    def paths(self) -> list[str]:
        if self.watch:
            try:
                if (now := os.stat(self.watch).st_mtime_ns) != self.seen:
                    with open(self.watch) as f:
                        self.watched = [x if isinstance(x, str) else x["path"] for x in json.load(f)]
                    self.seen = now
            except (OSError, ValueError, KeyError, TypeError):
                pass
        return sorted({*self.fixed, *self.watched})

    def ends(self) -> dict[str, list[int]]:
        out = {}
        for path in self.paths():
            try:
                at = os.stat(path)
                out[path] = [at.st_ino, whole_lines(path, at.st_size)]
            except OSError:
                out[path] = [0, 0]  # whatever comes there is new
        return out

    def initialOffset(self) -> dict:  # noqa: N802
        return {path: [inode, 0 if self.from_start else end] for path, (inode, end) in self.ends().items()}

    def latestOffset(self) -> dict:  # noqa: N802
        return self.ends()

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for path, (inode, stop) in end.items():
            if path not in start:  # new to the list: from its end, unless all is wanted
                begin = 0 if self.from_start else stop
            else:
                was, at = start[path]
                begin = at if was == inode and at <= stop else 0
            out += [Piece(path, begin, a, min(a + SPLIT_BYTES, stop)) for a in range(begin, stop, SPLIT_BYTES)]
        return out

    def read(self, piece: Piece) -> Iterator[tuple[str, int, str]]:
        with open(piece.path, "rb") as f:
            if piece.start > piece.begin:  # the line that began before belongs to the piece before
                f.seek(piece.start - 1)
                f.readline()
            else:
                f.seek(piece.start)
            while (at := f.tell()) < piece.stop and (line := f.readline()):
                yield piece.path, at, line.rstrip(b"\r\n").decode("utf-8", "replace")[: self.limit]

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """source_file, line_no (the line's first byte: grows with the lines), raw."""

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return "source_file string, line_no long, raw string"

    def streamReader(self, schema) -> TailReader:  # noqa: N802
        return TailReader(self.options)
