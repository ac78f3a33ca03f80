"""Helpers that the operators of this subpackage share: tables, the shared folder, chunk streams of Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.session import ship
from lumenlog.storage import discard, settle, shared_dir  # noqa: F401

#: Bytes of text that a vectorised scan holds at once; a single longer text is still scanned whole.
PIECE_BYTES = 1 << 19
#: Parts that the rows of a frequent join key are dealt over.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The columns of a table; whatever else the table holds is never read."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


@contextmanager
def shuffled_joins(spark: SparkSession) -> Iterator[None]:
    """Joins that run inside shuffle both sides at every size, where Spark would broadcast those that are small yet. What is only planned inside isn't bound by it."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(name)
    spark.conf.set(name, -1)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def join_hot(rows: DataFrame, other: DataFrame, keys: list[str], salt: str, how: str = "inner") -> DataFrame:
    """rows, a settled table, joined with other on keys, of which other has one row each. A key's rows are dealt out by the column salt, a
    number below SALTS, and other's row goes only where the key has rows, so that no task gets a frequent key whole."""
    spread = rows.select(*keys, salt).distinct().join(other, keys)
    return rows.join(spread, [*keys, salt], how)


def salt_of(*columns: str) -> Column:
    """A number below SALTS from the columns."""
    return F.pmod(F.xxhash64(F.lit(77), *columns), F.lit(SALTS)).cast("int")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as it takes to differ from all columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Returns freed memory of this Python process to the machine. Workers are used again and again, so what an earlier task freed would
    stay theirs. Called at the end of a task or batch; where the C library has no such call, only Arrow's pool is emptied."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def least_hashes(df: DataFrame, h: Column, rows: int) -> DataFrame:
    """At most rows rows of df with the least h, a 64-bit hash, ties in a fixed order. Rows that can't be among them are left out first,
    so that a task sends few."""
    share = min(1.0, 4 * rows / max(df.count(), 1))
    found = df.withColumn("_h", h)
    if share < 1:
        found = found.filter(F.col("_h") < F.lit(int(-(2**63) + share * 2**64)))
    return found.orderBy("_h", *df.columns).limit(rows).drop("_h")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def text_array(column: pa.Array) -> pa.Array:
    """The column as strings, null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("") if column.null_count else column


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and the n + 1 offsets of the texts in them."""
    column = text_array(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def pieces(data: np.ndarray, offs: np.ndarray, limit: int = PIECE_BYTES, rows: int = 1 << 14) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about limit bytes: first row, row after the last, bytes, offsets."""
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = min(max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1), lo + rows, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# --- words -----------------------------------------------------------------
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: digits, letters, and all of any code point from U+0080.
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[65:91] = IS_WORD[128:] = True
#: Bytes of tokens that white space separates.
IS_DARK = np.ones(256, bool)
IS_DARK[32] = IS_DARK[9:14] = False

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, PIECE_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def spans(data: np.ndarray, offs: np.ndarray, member: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes inside each text, and n + 1 offsets of the texts among the runs."""
    inside = member[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    if len(data):
        edge[0] = edge[-1] = True
    edge[offs] = True  # a run ends where its text ends
    at = np.flatnonzero(edge)
    if len(at) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    keep = inside[at[:-1]]
    starts, ends = at[:-1][keep], at[1:][keep]
    return starts, ends, np.searchsorted(starts, offs)


class RunHasher:
    """64-bit hashes of runs of folded bytes: equal bytes, equal hashes, wherever they stand."""

    def __init__(self, data: np.ndarray, fold: np.ndarray = LOWER):
        power, self.inverse = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((fold[data].astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """RunHasher for one set of runs."""
    return RunHasher(data, fold)(starts, ends)


def word_hash(words: list[str], fold: np.ndarray = LOWER) -> np.ndarray:
    """span_hashes of whole strings."""
    if not words:
        return np.zeros(0, np.uint64)
    data, offs = text_bytes(pa.array(words, pa.large_string()))
    return span_hashes(data, offs[:-1], offs[1:], fold)
