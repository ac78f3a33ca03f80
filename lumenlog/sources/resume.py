"""Batch runs over growing files: byte ranges of what earlier runs haven't read, and a manifest that says how far they came.

A file is known by its device and inode and the hash of its first bytes, so a renamed one goes on where it was, and a new one under an old name, or with an old inode, is read
whole. A run reads from there to the last line end; a half line at the end waits, unless the file hasn't changed for a while. Ranges are the
partitions of a Python data source, split at any byte and aligned to the code units of the encoding; a line belongs to the range that it starts in.

All that run n writes lies in folders of its own (run=n), which a run with the same number writes anew. Only then is manifest n put in place, by one rename that fails
where another run was faster. So a run that dies in between is as if it hadn't been, and nothing is lost or doubled. Files must be visible to the
driver and the executors by the same path.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field
from urllib.parse import unquote, urlparse

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of one range, a multiple of every code unit.
SPLIT_BYTES = 64 << 20
#: First bytes of a file that tell it from another one with its inode.
HEAD_BYTES = 256
BLOCK = 1 << 20
#: Lines and bytes of an Arrow batch.
BATCH_LINES, BATCH_BYTES = 8192, 4 << 20
#: Encodings whose line ends are wider than a byte: the code unit and the line end.
WIDE = {"utf-16-le": (2, b"\n\0"), "utf-16-be": (2, b"\0\n"), "utf-32-le": (4, b"\n\0\0\0"), "utf-32-be": (4, b"\0\0\0\n")}
BOMS = {"utf-16": ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")), "utf-32": ((b"\xff\xfe\0\0", "utf-32-le"), (b"\0\0\xfe\xff", "utf-32-be"))}


@dataclass
class FileRange:
    """The bytes [begin, stop) of a file that a run reads, with lines before them."""

    name: str
    path: str
    id: str
    begin: int
    stop: int
    lines: int = 0
    codec: str = "utf-8"


@dataclass
class Manifest:
    """Run number and, by file id, path, offset, lines and head (bytes and their hash)."""

    number: int = 0
    files: dict[str, dict] = field(default_factory=dict)


def local_path(name: str) -> str:
    """The path of a file name as Spark has it; ValueError where it isn't one that the operating system can open."""
    at = urlparse(name)
    if at.scheme not in ("", "file"):
        raise ValueError(f"{name}: runs can go on in files only, which driver and executors see by the same path")
    return unquote(at.path) if at.scheme else name


def wide_codec(encoding: str) -> str:
    """The name of an encoding, in the form in which WIDE and BOMS have it."""
    name = encoding.lower().replace("_", "-").replace("utf16", "utf-16").replace("utf32", "utf-32")
    return name.replace("16le", "16-le").replace("16be", "16-be").replace("32le", "32-le").replace("32be", "32-be")


def codec_of(path: str, encoding: str) -> tuple[str, int]:
    """The codec of a file, and how many bytes of a byte order mark it begins with. Without a mark wide units are little-endian, as Python takes them."""
    name = wide_codec(encoding)
    if name not in BOMS:
        return name, 0
    with open(path, "rb") as f:
        head = f.read(4)
    for mark, codec in BOMS[name]:
        if head.startswith(mark):
            return codec, len(mark)
    return f"{name}-le", 0


def read_line(f, unit: int, end: bytes) -> bytes:
    """The bytes of a line with its end, from a file that is at a line's code unit."""
    line = f.readline()
    if unit == 1:
        return line
    while line:
        if end[0] == 10 and len(line) % unit == 1 and line[-1] == 10:
            line += f.read(unit - 1)
        if len(line) % unit == 0 and line[-unit:] == end:
            return line
        if not (more := f.readline()):
            return line
        line += more
    return line


def last_end(path: str, size: int, unit: int, end: bytes) -> int:
    """The byte behind the last line end in the first size bytes; 0 if there is none."""
    size -= size % unit
    with open(path, "rb") as f:
        while size > 0:
            low = max(0, size - BLOCK)
            f.seek(low)
            data = f.read(size - low)
            at = data.rfind(end)
            while at >= 0 and at % unit:
                at = data.rfind(end, 0, at + unit - 1)
            if at >= 0:
                return low + at + unit
            size = low
    return 0


def head_of(path: str, size: int) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read(size)).hexdigest()


def plan(names: Sequence[str], known: Manifest, encoding: str = "utf-8", idle_seconds: float = 300.0, now: float | None = None) -> tuple[list[FileRange], int]:
    """What of the files is to be read, and how many of them have nothing new. A half line counts as whole once its file is idle_seconds old."""
    out, skipped, seen = [], 0, set()
    for name in names:
        path = local_path(name)
        at = os.stat(path)
        key = f"{at.st_dev}:{at.st_ino}"
        if key in seen:  # another name of the same file
            continue
        seen.add(key)
        codec, mark = codec_of(path, encoding)
        unit, end = WIDE.get(codec, (1, b"\n"))
        stop = at.st_size - at.st_size % unit
        if (time.time() if now is None else now) - at.st_mtime < idle_seconds:
            stop = last_end(path, at.st_size, unit, end)
        told = known.files.get(key)
        if told and (at.st_size < told["offset"] or head_of(path, told["head_bytes"]) != told["head"]):
            told = None  # another file, or the same one begun anew
        begin = told["offset"] if told else mark
        out.append(FileRange(name, path, key, begin, max(stop, begin), told["lines"] if told else 0, codec))
        skipped += begin >= stop
    return out, skipped


@dataclass
class Piece(InputPartition):
    """The lines of a FileRange that start in [start, stop)."""

    of: dict
    start: int
    stop: int


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files = [FileRange(**f) for f in json.loads(options["plan"])]
        self.split = int(options.get("split", SPLIT_BYTES))
        self.counts = options.get("counts") == "true"

    def partitions(self) -> list[Piece]:
        out = [Piece(asdict(f), a, min(a + self.split, f.stop)) for f in self.files for a in range(f.begin, f.stop, self.split)]
        return out or [Piece(asdict(FileRange("", "", "", 0, 0)), 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        f = FileRange(**piece.of)
        if piece.start >= piece.stop:
            return
        found = ranged_lines(f, piece.start, piece.stop)
        if self.counts:
            n = count_ends(f, piece.start, piece.stop) if f.codec not in WIDE else sum(1 for _ in found)
            yield pa.RecordBatch.from_arrays([pa.array([f.name]), pa.array([piece.start]), pa.array([n])], ["source_file", "piece", "n"])
            return
        done, rows, size = 0, [], 0
        for line in found:
            rows.append(line.decode(f.codec, "replace").rstrip("\r\n"))
            size += len(line)
            if len(rows) >= BATCH_LINES or size >= BATCH_BYTES:
                yield self._batch(f, piece, done, rows)
                done, rows, size = done + len(rows), [], 0
        if rows:
            yield self._batch(f, piece, done, rows)

    def _batch(self, f: FileRange, piece: Piece, done: int, rows: list[str]) -> pa.RecordBatch:
        n = len(rows)
        columns = [pa.array([f.name] * n), pa.array([piece.start] * n, pa.int64()), pa.array(range(done + 1, done + n + 1), pa.int64()), pa.array(rows, pa.string()), pa.array([f.stop] * n, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["source_file", "piece", "at", "raw", "file_size"])


def ranged_lines(f: FileRange, start: int, stop: int) -> Iterator[bytes]:
    """The lines of a file that start in [start, stop), with their ends; nothing beyond f.stop."""
    unit, end = WIDE.get(f.codec, (1, b"\n"))
    with open(f.path, "rb") as data:
        if start > f.begin:  # the line that began before belongs to the range before
            data.seek(start - unit)
            read_line(data, unit, end)
        else:
            data.seek(start)
        while (at := data.tell()) < stop and (line := read_line(data, unit, end)):
            yield line[: f.stop - at]


def count_ends(f: FileRange, start: int, stop: int) -> int:
    """How many lines ranged_lines gives, told by line ends alone."""
    n = int(start == f.begin)
    with open(f.path, "rb") as data:
        at = start if start == f.begin else start - 1
        data.seek(at)
        while at < stop - 1 and (block := data.read(min(BLOCK, stop - 1 - at))):
            n += block.count(b"\n")
            at += len(block)
    return n


class RangeSource(DataSource):
    """Lines of byte ranges: source_file, piece (the range's first byte), at (place in the range, from 1), raw, file_size; or with counts the number n of a range's lines."""

    @classmethod
    def name(cls) -> str:
        return "line_ranges"

    def schema(self) -> str:
        return "source_file string, piece long, n long" if self.options.get("counts") == "true" else "source_file string, piece long, at long, raw string, file_size long"

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)


def read_ranges(spark: SparkSession, files: Sequence[FileRange], split: int = SPLIT_BYTES) -> tuple[DataFrame, dict[str, int]]:
    """source_file, line_no, raw, file_size of all ranges, and how many lines each file has in them. Counting the lines of ranges is a pass that looks for line ends only."""
    spark.dataSource.register(RangeSource)
    reader = spark.read.format("line_ranges").option("plan", json.dumps([asdict(f) for f in files if f.begin < f.stop])).option("split", split)
    counts = reader.option("counts", "true").load().toPandas()  # a row for each range
    before = counts.sort_values(["source_file", "piece"]).copy()
    first = {f.name: f.lines for f in files}
    before["skip"] = before.groupby("source_file")["n"].cumsum() - before["n"] + before["source_file"].map(first).fillna(0).astype("int64")
    firsts = spark.createDataFrame([(str(r.source_file), int(r.piece), int(r.skip)) for r in before.itertuples()], "source_file string, piece long, skip long")
    lines = reader.option("counts", "false").load().join(firsts, ["source_file", "piece"])
    return lines.select("source_file", (F.col("at") + F.col("skip")).alias("line_no"), "raw", "file_size"), {k: int(v) for k, v in counts.groupby("source_file")["n"].sum().items()}


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def newest(spark: SparkSession, folder: str) -> Manifest:
    """The manifest with the highest number in a folder; number 0 without files where there is none."""
    at, fs = _fs(spark, folder)
    if not fs.exists(at):
        return Manifest()
    numbers = [int(name[:-5]) for x in fs.listStatus(at) if (name := x.getPath().getName()).endswith(".json") and name[:-5].isdigit()]
    if not numbers:
        return Manifest()
    stream = fs.open(_fs(spark, f"{folder}/{max(numbers)}.json")[0])
    try:
        return Manifest(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def put_manifest(spark: SparkSession, folder: str, manifest: Manifest) -> None:
    """Puts a manifest in place: written aside, then renamed, and only where no other run has put one with this number."""
    at, fs = _fs(spark, folder)
    fs.mkdirs(at)
    aside, there = _fs(spark, f"{folder}/.{uuid.uuid4().hex}")[0], _fs(spark, f"{folder}/{manifest.number}.json")[0]
    out = fs.create(aside)
    out.write(bytearray(json.dumps(asdict(manifest)).encode()))
    out.close()
    try:
        moved = not fs.exists(there) and fs.rename(aside, there)
    except Py4JJavaError:
        moved = False
    if not moved:
        fs.delete(aside, False)
        raise RuntimeError(f"{folder}: another run has put manifest {manifest.number}")


def went_on(known: Manifest, files: Sequence[FileRange], lines: dict[str, int]) -> Manifest:
    """The manifest after a run has read its ranges. Files that the run didn't see stay known."""
    out = dict(known.files)
    for f in files:
        head = min(HEAD_BYTES, f.stop)
        out[f.id] = {"path": f.path, "offset": f.stop, "lines": f.lines + lines.get(f.name, 0), "head_bytes": head, "head": head_of(f.path, head)}
    return Manifest(known.number + 1, out)
