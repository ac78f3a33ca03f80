"""Hard-negative mining: for each anchor and each of its positives, the best-scored rows of other labels within a window below the positive's score.

Secondary-sort shuffle: a pair's score is packed into a key (anchor, descending score, side, id), repartitionAndSortWithinPartitions deals keys out by anchor and
sorts them, and an iterator walks through them: a positive opens a window, a negative is emitted for each open window that it falls into, until that is full. The iterator
holds an anchor's few open windows and never its pairs.

Rows meet anchors in blocks of about ANCHORS, so nothing that grows with the table is held whole. Before the shuffle each task keeps, of its own rows, an
anchor's best positives, and in a second pass, once the anchor's positives are known, the best rows in each of their windows: no other row of the task can be
in the result. So a shuffle moves a few pairs for each anchor and task, however many rows there are and whichever label is frequent.

Scores are inner products of integers floor(scale * x). They are exact: products in doubles where these hold them, else in Python integers, and beyond 64 bits the nearest 64-bit
value. Defined results: rows without a label or vector, or with a null or non-finite component, take no part; repeated rows and ids are rows of their own, and
an anchor's copies are among its others; ids that are null are never anchors and come last among equal scores; vectors of different lengths don't meet; a positive
with a score below 0 has an empty window; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlog.llm.common import give_back, settle, table

#: Anchors that rows meet at a time, on average.
ANCHORS = 4096
#: Anchors that are scored together against a batch.
GROUP = 64
#: Kept pairs of a task from which on they are thinned out.
HELD = 1 << 20
FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
#: anchor row, falling score, side (0 positive, 1 negative), whether the id is null, id, row: big-endian and unsigned, so that bytes sort as the values do.
_KEY = struct.Struct(">QQBBQQ")


@dataclass(frozen=True)
class Mining:
    """every: ids divisible by it are anchors; positives and negatives: how many are taken; window: bounds of negatives in hundredths of the positive's score;
    relabel: ids divisible by it count with the next of labels; scale: of components."""

    every: int = 100
    positives: int = 5
    negatives: int = 10
    window: tuple[int, int] = (30, 90)
    relabel: int = 7
    labels: int = 10
    scale: int = 256

    def bounds(self, score: int) -> tuple[int, int]:
        """Least and largest score of negatives for a positive's score: low > high where there is none."""
        return -(-self.window[0] * score // 100), self.window[1] * score // 100


def usable(vectors: DataFrame, rule: Mining) -> DataFrame:
    """row (a number of its own), vec_id, label, vector (integers) of the rows that take part, settled."""
    x = F.col("embedding")
    whole = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    moved = F.coalesce(F.col("vec_id") % rule.relabel == 0, F.lit(False))
    label = F.when(moved, (F.col("label").cast("long") + 1) % rule.labels).otherwise(F.col("label").cast("long"))
    parts = F.transform(x, lambda v: F.floor(v.cast("double") * rule.scale).cast("long"))
    rows = vectors.filter(F.col("label").isNotNull() & x.isNotNull() & whole)
    return settle(rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), parts.alias("vector")), "vectors")


def matrices(batch: pa.Table | pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: places of the rows with vectors of that length, and their matrix."""
    column = batch.column("vector")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths, flat = np.asarray(column.value_lengths()), column.flatten().to_numpy(zero_copy_only=False)
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    out = {}
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        out[int(d)] = at, flat[begins[at][:, None] + np.arange(d)].astype(np.int64).reshape(len(at), int(d))
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices, exact within 64 bits."""
    largest = lambda m: max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    if largest(a) * largest(b) * max(a.shape[1], 1) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.array([[min(max(int(v), _LOW), _HIGH) for v in row] for row in exact], np.int64).reshape(exact.shape)


class Kept:
    """Pairs that a task keeps: of each group (an anchor, or an anchor's window) the best by score, then id, then row."""

    def __init__(self, most: int):
        self.most, self.parts, self.size = most, [], 0

    def add(self, group: np.ndarray, score: np.ndarray, lost: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        self.parts.append((group, score, lost, vec_id, row))
        self.size += len(group)
        if self.size > HELD:
            self.parts = [self.best()]
            self.size = len(self.parts[0][0])

    def best(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        group, score, lost, vec_id, row = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((row, vec_id, lost, ~score, group))  # ~ reverses integers without overflow
        group = group[order]
        new = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        nth = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        order = order[nth < self.most]
        return tuple(x[order] for x in (np.concatenate([p[0] for p in self.parts]), score, lost, vec_id, row))


def _scored(block: pa.Table, windows: dict[int, list[tuple[int, int]]] | None, rule: Mining) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows: anchor (row), score, lost, vec_id, row of the pairs that a task keeps: positives where windows is None, else negatives inside the
    windows (bounds by anchor row)."""
    anchors = {d: (at, m) for d, (at, m) in matrices(block).items()}
    anchor_row, anchor_label = block["row"].to_numpy(), block["label"].to_numpy()
    most = rule.positives if windows is None else rule.negatives

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Kept(most)
        for batch in batches:
            row, label = batch.column("row").to_numpy(), batch.column("label").to_numpy()
            lost = np.asarray(batch.column("vec_id").is_null()).astype(np.int64)
            vec_id = batch.column("vec_id").fill_null(0).to_numpy()
            for d, (at, matrix) in matrices(batch).items():
                if d not in anchors:
                    continue
                # Rows in the order of ties, so that a stable sort by score is the order that counts.
                at = at[order] if len(order := np.lexsort((row[at], vec_id[at], lost[at]))) else at
                matrix, places = matrix[order], anchors[d][0]
                for g in range(0, len(places), GROUP):
                    group = places[g : g + GROUP]
                    scores = products(anchors[d][1][g : g + GROUP], matrix)
                    same = anchor_label[group][:, None] == label[at][None, :]
                    for k, a in enumerate(group):
                        if windows is None:
                            take = np.flatnonzero(same[k] & (row[at] != anchor_row[a]))
                            take = take[best_of(scores[k][take], most)]
                            kept.add(np.full(len(take), a), scores[k][take], lost[at[take]], vec_id[at[take]], row[at[take]])
                            continue
                        other = np.flatnonzero(~same[k])
                        own = scores[k][other]
                        for w, (low, high) in enumerate(windows.get(int(anchor_row[a]), ())):
                            take = other[(own >= low) & (own <= high)]
                            take = take[best_of(scores[k][take], most)]
                            kept.add(np.full(len(take), a * rule.positives + w), scores[k][take], lost[at[take]], vec_id[at[take]], row[at[take]])
        group, score, lost, vec_id, row = kept.best()
        if windows is not None:  # a row counts once for an anchor, whichever of its windows it is in
            group = group // rule.positives
            once = np.unique(np.stack([group, row], 1), axis=0, return_index=True)[1]
            group, score, lost, vec_id, row = (x[once] for x in (group, score, lost, vec_id, row))
        told = (anchor_row[group.astype(np.int64)], score, lost, vec_id, row)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in told], ["anchor", "score", "lost", "vec_id", "row"])
        give_back()

    return scan


def best_of(scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the most highest scores, ties by place, in order."""
    if len(scores) > 4 * most:
        bar = np.partition(scores, len(scores) - most)[len(scores) - most]
        near = np.flatnonzero(scores >= bar)
        return near[np.argsort(~scores[near], kind="stable")[:most]]
    return np.argsort(~scores, kind="stable")[:most]


def pack(anchor: int, score: int, side: int, lost: int, vec_id: int, row: int) -> bytes:
    """The key of a pair."""
    return _KEY.pack(anchor, _HIGH - score, side, lost, vec_id - _LOW, row)


def unpack(key: bytes) -> tuple[int, int, int, int | None]:
    """anchor, score, side, vec_id of a key."""
    anchor, fall, side, lost, vec_id, _ = _KEY.unpack(key)
    return anchor, _HIGH - fall, side, None if lost else vec_id + _LOW


def _partition(key: bytes) -> int:
    return zlib.crc32(key[:8])


def opened(rule: Mining) -> Callable[[Iterator[tuple[bytes, int]]], Iterator[tuple]]:
    """Walks through the sorted keys of whole anchors, with the anchor's id as value, and emits rows of FOUND."""

    def walk(pairs: Iterator[tuple[bytes, int]]) -> Iterator[tuple]:
        at, windows, positives = None, [], 0
        for key, anchor_id in pairs:
            anchor, score, side, vec_id = unpack(key)
            if anchor != at:
                at, windows, positives = anchor, [], 0
            if side == 0:
                if positives < rule.positives:
                    positives += 1
                    windows.append([vec_id, score, *rule.bounds(score), 0])
                continue
            for w in windows:
                if w[2] <= score <= w[3] and w[4] < rule.negatives:
                    w[4] += 1
                    yield anchor_id, w[0], w[4], vec_id, w[1], score

    return walk


def mine(vectors: DataFrame, rule: Mining = Mining(), block_anchors: int = ANCHORS) -> DataFrame:  # noqa: B008
    """FOUND of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    rows = usable(vectors.select("vec_id", "embedding", "label"), rule)
    anchors = rows.filter(F.col("vec_id") % rule.every == 0)
    blocks = max(math.ceil(anchors.count() / block_anchors), 1)
    names = "anchor long, score long, lost long, vec_id long, row long"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = spark.createDataFrame([], FOUND)
    for b in range(blocks):
        block = anchors.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "vec_id", "label", "vector").toArrow()
        if not block.num_rows:
            continue
        ids = dict(zip(block["row"].to_pylist(), block["vec_id"].to_pylist(), strict=True))

        def keyed(pairs: DataFrame, side: int, ids: dict = ids):
            return pairs.rdd.map(lambda r: (pack(r.anchor, r.score, side, r.lost, r.vec_id, r.row), ids[r.anchor]))

        near = settle(rows.mapInArrow(_scored(block, None, rule), names), "positives")
        order = [F.col("score").desc(), "lost", "vec_id", "row"]
        nth = F.row_number().over(Window.partitionBy("anchor").orderBy(*order))
        near = settle(near.withColumn("nth", nth).filter(F.col("nth") <= rule.positives).drop("nth"), "nearest")
        windows: dict[int, list[tuple[int, int]]] = {}
        for r in near.select("anchor", "score").collect():  # at most rule.positives for each of the block's anchors
            low, high = rule.bounds(r.score)
            if low <= high:
                windows.setdefault(r.anchor, []).append((low, high))
        far = rows.mapInArrow(_scored(block, windows, rule), names)
        dealt = keyed(near, 0).union(keyed(far, 1)).repartitionAndSortWithinPartitions(parts, _partition)
        out = out.unionByName(settle(spark.createDataFrame(dealt.mapPartitions(opened(rule)), FOUND, verifySchema=False), "mined"))
    return out


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every anchor and positive."""
    return mine(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


OP12_SQL = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, b.vec_id, b.row, a.label = b.label AS same, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score FROM v a JOIN v b ON a.row <> b.row AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
pos AS (SELECT * FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, row) <= 5)
SELECT pos.anchor_id, pos.vec_id AS positive_id, row_number() OVER w::INT AS rank, n.vec_id AS negative_id, pos.score AS positive_score, n.score AS negative_score
FROM pos JOIN p n ON n.anchor = pos.anchor AND NOT n.same AND 30 * pos.score <= 100 * n.score AND 100 * n.score <= 90 * pos.score
WINDOW w AS (PARTITION BY pos.anchor, pos.row ORDER BY n.score DESC, n.vec_id, n.row) QUALIFY row_number() OVER w <= 10"""
