"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

Shingles are five consecutive words (runs of digits, letters and code points from U+0080, A-Z lower-cased); a text of one to four words
is one shingle. A shingle weighs (1 + ln tf) * idf; idf is 1 + ln(1 / p) / 4, where p is the share of documents with the shingle. op7_near_dedup
and the pipeline take every shingle's own share (rare=0): documents are written in pieces, the distinct shingles of a piece go to shards by
ranges of their hashes, a shard counts its shingles over all pieces, and the counts come back to the pieces.
A caller may have shares below `rare` taken as that (the default, 1/16), so that only what is common in the corpus weighs less; then a counting
sketch over all documents tells where common shingles must be, and a second pass counts these alone.

Weights alone part what a large group of copies shares: the more copies, the less its shingles weigh, while an edit's own weigh more the larger the corpus is. So
op7_near_dedup and the pipeline (sets=True) also link a pair whose plain sets of shingles have that Jaccard similarity, which neither size moves. Candidates
come by the weighted samples in any case.

Texts of equal words are one node. In two rounds, nodes that share a band's hash meet one leader of their bucket, at first the one
whose buckets are the largest (the original of a group of copies), then one by lot; each pair is verified exactly. So a bucket of n copies
takes n checks. Buckets that then still hold several classes are compared whole, in blocks of about BLOCK by BLOCK nodes, everything
against all nodes outside the bucket's largest class: pairs of different classes whose samples agree MATCHES times or more are
verified in place, in the first band that they share. Nobody's links are capped, and only similar pairs leave a block. Classes are connected components of
the verified pairs. A pair at similarity 0.8 shares a band with probability 0.9998, and agrees that often with 0.999999. Verified similarities are exact but for
32-bit hashes of shingles and 16-bit weights, which move them by less than 0.002 (tests compare them with sets of words).

Defined results: null and empty texts have no words, so no shingles; texts without words are copies where they are equal, null
as the empty text; null ids are never chosen as class ids unless a class has no other; repeated rows are copies, but an id that comes with
different texts stands for different documents; an empty table gives no rows; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import IS_WORD, SALTS, discard, free_name, give_back, join_hot, mix64, pieces, salt_of, settle, shuffled_joins, span_hashes, spans, table, text_bytes

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 3
#: Nodes of a block, and the least number of agreeing samples (of BANDS * ROWS) of a candidate pair of blocks.
BLOCK, MATCHES = 64, 16
#: Buckets of the counting sketch, in parts that are summed apart.
SKETCH, PARTS = 1 << 21, 64
#: Shingles in fewer documents than this share all weigh the same, where a caller doesn't ask for exact shares.
RARE = 1 / 16
#: Bytes of text of a piece and of a shard of exact shares, and the least number of shards.
PIECE, SHARD, SHARDS = 4 << 20, 32 << 20, 64


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: hashes (ordered within a text), how often they come, offsets of the texts; then all words' hashes and their offsets."""
    starts, ends, where = spans(data, offs)
    words = span_hashes(data, starts, ends)
    n = np.diff(where)
    owner = np.repeat(np.arange(len(n)), n)
    rolled = np.zeros(len(words), np.uint64)
    for k in range(WORDS):
        part = mix64(words + np.uint64(k + 1))
        rolled[: len(words) - k] += part[k:] if k else part
    left = np.repeat(where[1:], n) - np.arange(len(words))  # words of the text from here on
    full = left >= WORDS
    keys, docs = rolled[full], owner[full]
    short = np.flatnonzero((n > 0) & (n < WORDS))
    if len(short):
        whole = [np.sum([mix64(words[where[d] + k : where[d] + k + 1] + np.uint64(k + 1))[0] for k in range(n[d])], dtype=np.uint64) + np.uint64(n[d]) for d in short]
        keys, docs = np.concatenate([keys, np.array(whole, np.uint64)]), np.concatenate([docs, short])
    keys = mix64(keys)
    order = np.lexsort((keys, docs))
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(keys)))
    return keys[at], times, np.searchsorted(docs[at], np.arange(len(n) + 1)), words, where


def _count_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of a partition fall into each bucket of the sketch; part -1 counts the texts with words."""
    counts, total = np.zeros(SKETCH, np.uint32), 0
    for batch in batches:
        data, offs = text_bytes(batch.column("text"))
        for _, _, d, o in pieces(data, offs):
            keys, _, where, _, _ = shingles(d, o)
            np.add.at(counts, (keys >> np.uint64(43)).astype(np.int64), np.uint32(1))
            total += int((np.diff(where) > 0).sum())
    if total:
        pack = zstandard.ZstdCompressor(level=1)
        packed = [pack.compress(x.tobytes()) for x in np.split(counts, PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, PARTS), pa.int32()), pa.array([np.uint64(total).tobytes(), *packed], pa.binary())], ["part", "counts"])
    give_back()


def _sum_part(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums a part over all partitions: (bucket, count); (-1, number of texts) for part -1. Sums stream, so a part's memory is fixed."""
    part, total = key[0].as_py(), 0
    for batch in batches:
        for raw in batch.column("counts"):
            total = total + (np.frombuffer(raw.as_py(), np.uint64) if part < 0 else np.frombuffer(zstandard.ZstdDecompressor().decompress(raw.as_py()), np.uint32).astype(np.uint64))
    at = np.array([-1]) if part < 0 else np.flatnonzero(total) + part * (SKETCH // PARTS)
    total = total if part < 0 else total[total > 0]
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.astype(np.int64), pa.int64())], ["bucket", "n"])


def _count_keys(buckets: np.ndarray):
    """For mapInArrow: (key, n) of shingles in the buckets: how many texts of a batch have them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = np.zeros(SKETCH, bool)
        chosen[buckets] = True
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for _, _, d, o in pieces(*text_bytes(batch.column("text"))):
                keys = shingles(d, o)[0]
                found.append(keys[chosen[(keys >> np.uint64(43)).astype(np.int64)]])
            keys, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])
        give_back()

    return count


def common_shingles(docs: DataFrame, rare: float = RARE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that more than rare of the documents with words have, sorted, and their idf, both exact: the sketch, which never counts too
    few, tells in which buckets they must be, and the shingles of these are counted one by one. At most 1 / rare times the shingles of an average document."""
    parts = docs.select("text").mapInArrow(_count_part, "part int, counts binary").groupBy("part").applyInArrow(_sum_part, "bucket long, n long")
    parts = settle(parts, "sketch")
    total = max(parts.filter("bucket < 0").agg(F.max("n")).first()[0] or 0, 1)
    buckets = parts.filter((F.col("bucket") >= 0) & (F.col("n") > rare * total)).select("bucket").toArrow()["bucket"].to_numpy()
    discard(parts)
    if not len(buckets):
        return np.zeros(0, np.uint64), np.zeros(0)
    exact = docs.select("text").mapInArrow(_count_keys(buckets.astype(np.int64)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > rare * total).toArrow()
    keys, n = exact["key"].to_numpy().astype(np.int64).view(np.uint64), exact["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], 1 + np.log(total / n[order]) / 4


def weights(keys: np.ndarray, times: np.ndarray, common: tuple[np.ndarray, np.ndarray], rare: float = RARE) -> np.ndarray:
    """(1 + ln tf) * idf of shingles."""
    known, idf = common
    out = np.full(len(keys), 1 + np.log(1 / rare) / 4)
    if len(known):
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        out = np.where(known[at] == keys, idf[at], out)
    return (out * (1 + np.log(times))).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling. Gamma(2, 1) and uniform variates of a (shingle, function) come from fields of one hash by
    tables of quantiles; equal values are decided by the sample's own hash, which is as consistent."""

    def __init__(self, functions: int = BANDS * ROWS):
        x = np.concatenate([np.geomspace(1e-6, 0.05, 4000), np.linspace(0.05, 30, 60000)[1:]])
        quantile = lambda bits: np.interp((np.arange(1 << bits) + 0.5) / (1 << bits), 1 - (1 + x) * np.exp(-x), x).astype(np.float32)
        self.r, self.ln_c = quantile(12), np.log(quantile(16))
        self.beta = ((np.arange(1 << 12) + 0.5) / (1 << 12)).astype(np.float32)
        self.seeds = mix64(np.arange(1, functions + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def __call__(self, keys: np.ndarray, w: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Functions x texts: 32-bit hashes of the chosen (shingle, t). where: offsets of texts, none of which is empty."""
        ln_w, out = np.log(w), np.zeros((len(self.seeds), len(where) - 1), np.uint32)
        for k, seed in enumerate(self.seeds):
            h = (keys ^ seed) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(33)
            h *= np.uint64(0xC4CEB9FE1A85EC53)
            r = self.r[(h >> np.uint64(52)).astype(np.int64)]
            beta = self.beta[((h >> np.uint64(40)) & np.uint64(0xFFF)).astype(np.int64)]
            t = np.floor(ln_w / r + beta)
            ln_a = self.ln_c[((h >> np.uint64(24)) & np.uint64(0xFFFF)).astype(np.int64)] - r * (t - beta + 1)
            bits = ln_a.view(np.uint32)
            bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))  # orders as the floats do
            mark = ((h + t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0x94D049BB133111EB)) >> np.uint64(32)
            out[k] = np.minimum.reduceat(bits.astype(np.uint64) << np.uint64(32) | mark, where[:-1]).astype(np.uint32)
        return out


def _keys(data: np.ndarray, offs: np.ndarray, words: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Digest of each text's words, or of the text where it has none."""
    return [xxhash.xxh3_128_digest(b"w" + words[at[k] : at[k + 1]].tobytes() if at[k] < at[k + 1] else b"t" + data[offs[k] : offs[k + 1]].tobytes()) for k in range(len(offs) - 1)]


SIGNED = "doc_id long, key binary, bands array<long>, sign binary, vector binary, salt int"


def _signed(doc_id: pa.Array, parts: Iterator[tuple], weigh, sampler: Sampler, done: int) -> pa.RecordBatch:
    """SIGNED: doc_id, key (digest of the words), bands, sign (all samples), vector: shingles (sorted 32-bit hashes and float16 weights as bytes),
    salt (rows in turn). parts: bytes and offsets of texts with their shingles; weigh: weights of shingles."""
    keys, bands, signs_out, vectors = [], [], [], []
    for d, o, (found, times, where, words, at) in parts:
        n, w = len(o) - 1, weigh(found, times)
        full = np.flatnonzero(np.diff(where))
        signs = np.zeros((BANDS, n), np.int64)
        if len(full):
            place = np.cumsum(np.diff(where) > 0) - 1
            chosen = sampler(found, w, np.append(where[full], len(found)))
            for b in range(BANDS):
                code = np.full(len(full), b + 1, np.uint64)
                for row in chosen[b * ROWS : (b + 1) * ROWS]:
                    code = mix64(code * np.uint64(0x9E3779B97F4A7C15) + row.astype(np.uint64))
                signs[b, full] = code.view(np.int64)
        small, half = (found >> np.uint64(32)).astype(np.uint32), w.astype(np.float16)
        keys += _keys(d, o, words, at)
        for k in range(n):
            a, b = where[k], where[k + 1]
            if a == b:
                bands.append(None)
                signs_out.append(None)
                vectors.append(None)
            else:
                bands.append(signs[:, k])
                signs_out.append(chosen[:, place[k]].tobytes())
                vectors.append(small[a:b].tobytes() + half[a:b].tobytes())
    salts = (np.arange(done, done + len(keys)) % SALTS).astype(np.int32)
    columns = [doc_id, pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(signs_out, pa.binary()), pa.array(vectors, pa.binary()), pa.array(salts)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "bands", "sign", "vector", "salt"])


def _signatures(common: tuple[np.ndarray, np.ndarray], rare: float):
    """For mapInArrow: SIGNED of documents, by the idf of common shingles."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, done = Sampler(), 0
        for batch in batches:
            parts = ((d, o, shingles(d, o)) for _, _, d, o in pieces(*text_bytes(batch.column("text")), 1 << 17))
            yield _signed(batch.column("doc_id").cast(pa.int64()), parts, lambda found, times: weights(found, times, common, rare), sampler, done)
            done += batch.num_rows
        give_back()

    return scan


# --- exact shares of all shingles --------------------------------------------
def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte by byte of their numbers: of sorted hashes and of counts the high bytes hardly change."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in arrays))


def _unpack(raw: bytes, *kinds: type) -> list[np.ndarray]:
    data, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8), [], 0
    wide = [np.dtype(k).itemsize for k in kinds]
    n = len(data) // sum(wide)
    for kind, size in zip(kinds, wide, strict=True):
        out.append(np.ascontiguousarray(data[at : at + n * size].reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: piece, doc_ids, offs, texts (packed), bytes, full (texts with words)."""
    place, pack = (TaskContext.get().partitionId() << 32), zstandard.ZstdCompressor(level=3)
    for batch in batches:
        ids = batch.column("doc_id").cast(pa.int64())
        for lo, hi, d, o in pieces(*text_bytes(batch.column("text")), PIECE):
            inside = np.append(0, np.cumsum(IS_WORD[d]))[o]
            row = [place, ids[lo:hi].to_pylist(), o.tobytes(), pack.compress(d.tobytes()), len(d), int((np.diff(inside) > 0).sum())]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["piece", "doc_ids", "offs", "texts", "bytes", "full"])
            place += 1
    give_back()


def _parts(offs: bytes, texts: bytes) -> list[tuple]:
    """Bytes and offsets of a piece's texts in small parts, each with its shingles."""
    data, o = np.frombuffer(zstandard.ZstdDecompressor().decompress(texts), np.uint8), np.frombuffer(offs, np.int64)
    return [(d, own, shingles(d, own)) for _, _, d, own in pieces(data, o, 1 << 17)]


def _distinct(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a piece, sorted, and how many of its texts have them."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(x[2][0] for x in parts)]), return_counts=True)


def _to_shards(shards: int):
    """For mapInArrow: shard, piece, keys (distinct shingles of the piece in the shard's range of hashes, with counts, packed)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, offs, texts in zip(*(batch.column(c) for c in ("piece", "offs", "texts")), strict=True):
                keys, n = _distinct(_parts(offs.as_py(), texts.as_py()))
                cuts = np.searchsorted(((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32), np.arange(shards + 1, dtype=np.uint64))
                some = np.flatnonzero(np.diff(cuts))
                packed = [_pack(keys[cuts[k] : cuts[k + 1]], n[cuts[k] : cuts[k + 1]].astype(np.uint32)) for k in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([piece.as_py()] * len(some), pa.int64()), pa.array(packed, pa.binary())], ["shard", "piece", "keys"])
        give_back()

    return send


def _count_shard(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For applyInArrow: piece, shard, n (of each of the piece's shingles in the shard: how many documents have it, packed)."""
    at, keys, n = [], [], []
    for batch in batches:
        at += batch.column("piece").to_pylist()
        for raw in batch.column("keys"):
            own = _unpack(raw.as_py(), np.uint64, np.uint32)
            keys.append(own[0])
            n.append(own[1])
    ends = np.cumsum([len(x) for x in keys])[:-1]
    _, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(where, np.concatenate(n)).astype(np.uint32)
    packed = [_pack(x) for x in np.split(total[where], ends)]
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([key[0].as_py()] * len(at), pa.int32()), pa.array(packed, pa.binary())], ["piece", "shard", "n"])
    give_back()


def _sign_piece(total: int):
    """For a cogroup of a piece and its counts: SIGNED of its documents."""

    def sign(piece: pa.Table, counts: pa.Table) -> pa.Table:
        parts = _parts(piece["offs"][0].as_py(), piece["texts"][0].as_py())
        keys, _ = _distinct(parts)
        ordered = counts.sort_by("shard")["n"]  # shards are ranges of hashes, in order
        n = np.concatenate([np.zeros(0, np.uint32), *(_unpack(x.as_py(), np.uint32)[0] for x in ordered)])
        idf = 1 + np.log(total / n) / 4
        weigh = lambda found, times: (idf[np.searchsorted(keys, found)] * (1 + np.log(times))).astype(np.float32)
        out = pa.Table.from_batches([_signed(piece["doc_ids"].combine_chunks().flatten(), parts, weigh, Sampler(), piece["piece"][0].as_py())])
        give_back()
        return out

    return sign


def signed_by_all_shares(docs: DataFrame) -> DataFrame:
    """SIGNED of documents, settled, each shingle weighed by the exact share of documents that have it: no floor, no sample."""
    cut = settle(docs.mapInArrow(_cut, "piece long, doc_ids array<long>, offs binary, texts binary, bytes long, full long"), "pieces")
    size, total = cut.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("full"), F.lit(0))).first()
    sent = cut.select("piece", "offs", "texts").mapInArrow(_to_shards(max(SHARDS, -(-size // SHARD))), "shard int, piece long, keys binary")
    counts = settle(sent.groupBy("shard").applyInArrow(_count_shard, "piece long, shard int, n binary"), "shares")
    signed = settle(cut.select("piece", "doc_ids", "offs", "texts").groupBy("piece").cogroup(counts.groupBy("piece")).applyInArrow(_sign_piece(total), SIGNED), "signed")
    discard(cut, counts)
    return signed


def similarity(a: bytes, b: bytes, sets: bool = False) -> float:
    """Weighted Jaccard similarity of two packed vectors; with sets, that of their sets of shingles where it is more."""
    n, m = len(a) // 6, len(b) // 6
    ka, kb = np.frombuffer(a, np.uint32, n), np.frombuffer(b, np.uint32, m)
    wa, wb = np.frombuffer(a, np.float16, n, 4 * n).astype(np.float32), np.frombuffer(b, np.float16, m, 4 * m).astype(np.float32)
    at = np.minimum(np.searchsorted(kb, ka), m - 1)
    same = kb[at] == ka
    least = float(np.minimum(wa[same], wb[at[same]]).sum())
    found, shared = least / max(float(wa.sum() + wb.sum()) - least, 1e-9), int(same.sum())
    return max(found, shared / (n + m - shared)) if sets else found


def _compare(sets: bool):
    """For mapInArrow: the similarity of each pair."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sim = [similarity(a, b, sets) for a, b in zip(batch.column("va").to_pylist(), batch.column("vb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("leader"), pa.array(sim, pa.float64())], ["key", "leader", "similarity"])
        give_back()

    return compare


def _block_pairs(least: float, sets: bool):
    """For mapInArrow: similar pairs of two blocks' nodes of different classes, the lesser key first. A pair counts in the first of its shared bands only."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for band, left, right in zip(batch.column("band").to_pylist(), batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                a, b = (np.frombuffer(b"".join(x["sign"] for x in side), np.uint32).reshape(len(side), -1) for side in (left, right))
                agree, first = np.zeros((len(left), len(right)), np.int32), np.full((len(left), len(right)), BANDS)
                for k in range(BANDS):
                    same = [a[:, r, None] == b[None, :, r] for r in range(k * ROWS, (k + 1) * ROWS)]
                    agree += np.sum(same, axis=0)
                    first[np.all(same, axis=0) & (first == BANDS)] = k
                for i, j in zip(*np.nonzero((agree >= MATCHES) & (first == band)), strict=True):
                    x, y = left[i], right[j]
                    if x["root"] != y["root"] and (found := similarity(x["vector"], y["vector"], sets)) >= least:
                        out.append((*sorted((x["key"], y["key"])), found))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.float64()))], ["key", "leader", "similarity"])
        give_back()

    return compare


def verified_pairs(signed: DataFrame, nodes: DataFrame, least: float = SIMILARITY, sets: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pairs (key, leader) of similar nodes, and (key, root) of all nodes in them: the least key of their component.

    A bucket's nodes are dealt over SALTS tasks by salt, here and in all joins on its (band, h); so are the pairs of a leader.
    """
    spark = signed.sparkSession
    members = settle(nodes.filter("bands IS NOT NULL").select("key", salt_of("key").alias("salt"), F.posexplode("bands").alias("band", "h")), "members")
    counts = members.groupBy("band", "h", "salt").agg(F.count("*").alias("n")).groupBy("band", "h").agg(F.sum("n").alias("n"), F.collect_list("salt").alias("salts"))
    shared = counts.filter("n > 1").select("band", "h", "n", F.explode("salts").alias("salt"))
    every = settle(members.join(shared, ["band", "h", "salt"]), "shared")  # nodes in buckets of several
    discard(members)
    one = nodes.join(every.select("key").distinct(), "key", "left_semi").select("key", "rep")
    vectors = settle(signed.select("key", "doc_id", "vector").join(one, (signed["key"] == one["key"]) & signed["doc_id"].eqNullSafe(one["rep"])).select(signed["key"], "vector").dropDuplicates(["key"]), "vectors")

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = settle(pairs.select(F.least("key", "leader").alias("key"), F.greatest("key", "leader").alias("leader")).distinct().withColumn("salt", salt_of("key")), "tried")
        both = join_hot(pairs, vectors.select(F.col("key").alias("leader"), F.col("vector").alias("vb")), ["leader"], "salt").join(vectors.select("key", F.col("vector").alias("va")), "key")
        return both.select("key", "leader", "va", "vb").mapInArrow(_compare(sets), "key binary, leader binary, similarity double").filter(F.col("similarity") >= least)

    found = spark.createDataFrame([], "key binary, leader binary, similarity double")
    reach = every.groupBy("key").agg(F.sum("n").alias("reach"))
    for by_lot in (False, True):
        order = F.xxhash64("key", "band") if by_lot else F.col("reach")
        leaders = every.join(reach, "key").groupBy("band", "h").agg(F.max(F.struct(order.alias("by"), "key")).alias("at"), F.collect_set("salt").alias("salts"))
        leaders = leaders.select("band", "h", F.col("at.key").alias("leader"), F.explode("salts").alias("salt"))
        found = found.unionByName(verify(every.join(leaders, ["band", "h", "salt"]).filter("key <> leader")))
    found = settle(found, "led")
    roots = components(found)

    placed = settle(every.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "rooted")
    largest = placed.groupBy("band", "h", "root").agg(F.count("*").alias("own")).groupBy("band", "h").agg(F.max(F.struct("own", "root")).alias("at"), F.count("*").alias("classes"))
    mixed = settle(join_hot(placed, largest.filter("classes > 1").select("band", "h", F.col("at.root").alias("major")), ["band", "h"], "salt"), "mixed")
    discard(placed, every)
    # A bucket's blocks of minor nodes meet each of its blocks, wherever that lies: minor ones are sent to all of them.
    parts = F.ceil(F.col("n") / BLOCK).cast("long")
    node = F.struct("key", "root", "sign", "vector").alias("node")
    whole = mixed.join(nodes.select("key", "sign"), "key").join(vectors, "key").select("band", "h", F.pmod(F.xxhash64("key"), parts).alias("part"), parts.alias("parts"), node, (F.col("root") != F.col("major")).alias("minor"))
    left = whole.filter("minor").groupBy("band", "h", "part", "parts").agg(F.collect_list("node").alias("left")).select("band", "h", "left", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    right = whole.groupBy("band", "h", "part").agg(F.collect_list("node").alias("right"))
    compared = left.join(right, ["band", "h", "part"]).select("band", "left", "right")
    more = settle(compared.mapInArrow(_block_pairs(least, sets), "key binary, leader binary, similarity double").distinct(), "blocks")
    if more.isEmpty():
        return found, roots
    found = settle(found.unionByName(more), "similar")
    return found, components(found)


def components(pairs: DataFrame) -> DataFrame:
    """key, root of all keys in pairs (key, leader): the least key of its connected component. Labels spread along pairs and then jump to their
    label's label. A node of many pairs, and a label of many nodes, are dealt over tasks by salt."""
    edges = pairs.select(F.col("key").alias("a"), F.col("leader").alias("b")).unionByName(pairs.select(F.col("leader").alias("a"), F.col("key").alias("b"))).distinct()
    edges = settle(edges.withColumn("salt", salt_of("a")), "edges")
    labels = settle(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("key"), F.least("a", "b").alias("root")), "labels")
    while True:
        near = join_hot(edges, labels.select(F.col("key").alias("b"), "root"), ["b"], "salt").groupBy("a").agg(F.min("root").alias("seen"))
        step = labels.join(near, labels["key"] == near["a"]).select("key", F.col("root").alias("was"), F.least("root", "seen").alias("mid"), salt_of("key").alias("salt"))
        step = settle(step, "steps")
        jump = labels.select(F.col("key").alias("mid"), F.col("root").alias("far"))
        moved = settle(join_hot(step, jump, ["mid"], "salt").select("key", "was", F.least("mid", "far").alias("root")), "labels")
        discard(step)
        labels = moved.select("key", "root")
        if moved.filter("was <> root").isEmpty():
            discard(edges)
            return labels


def classes_of(docs: DataFrame, least: float = SIMILARITY, rare: float = RARE, sets: bool = False) -> DataFrame:
    """near_duplicates with key (digest of the words) and root (the least key of the class)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = settle(docs.mapInArrow(_signatures(common_shingles(docs, rare), rare), SIGNED), "signed") if rare else signed_by_all_shares(docs)
    nodes = settle(signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"), F.first("bands").alias("bands"), F.first("sign").alias("sign")), "nodes")
    with shuffled_joins(docs.sparkSession):
        told = _told(signed, nodes, least, sets)
    return join_hot(signed.select("doc_id", "key", "salt"), told, ["key"], "salt").select("doc_id", "key", "root", "class_id", "class_rows", "n_verified")


def _told(signed: DataFrame, nodes: DataFrame, least: float, sets: bool) -> DataFrame:
    """key, root, class_id, class_rows, n_verified of all nodes, settled."""
    pairs, roots = verified_pairs(signed, nodes, least, sets)
    links = pairs.select("key", "leader").distinct().select(F.explode(F.array("key", "leader")).alias("key")).groupBy("key").agg(F.count("*").alias("n_verified"))
    placed = nodes.select("key", "rep", "rows").join(roots, "key", "left").join(links, "key", "left").select("key", "rep", "rows", F.coalesce("root", "key").alias("root"), F.coalesce("n_verified", F.lit(0)).cast("long").alias("n_verified"), salt_of("key").alias("salt"))
    placed = settle(placed, "placed")
    classes = placed.groupBy("root").agg(F.min("rep").alias("class_id"), F.sum("rows").alias("class_rows"))
    return settle(join_hot(placed, classes, ["root"], "salt").select("key", "root", "class_id", "class_rows", "n_verified"), "classes")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, rare: float = RARE, sets: bool = False) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), class_key (the class itself, also where ids repeat or lack), class_rows, n_verified
    (pairs with other texts that were verified and found similar: links inside a class that its other links already join aren't tried, so no
    count of similar texts). A row for each document. Shares of documents below rare count as that; 0 takes every shingle's own.
    sets: pairs whose sets of shingles are as similar are linked too."""
    return classes_of(docs, least, rare, sets).withColumn("class_key", F.lower(F.hex("root"))).drop("key", "root")


def text_key(column: pa.Array) -> pa.Array:
    """The key of each text, as classes_of has it."""
    out = []
    for _, _, d, o in pieces(*text_bytes(column)):
        starts, ends, at = spans(d, o)
        out += _keys(d, o, span_hashes(d, starts, ends), at)
    return pa.array(out, pa.binary())


def keep_one(docs: DataFrame, least: float = SIMILARITY, rare: float = RARE, sets: bool = False) -> DataFrame:
    """docs with one row of each class: that of the least id, of several texts with it that of the least key; a row without an id only
    where the class has no other. Texts are read again only where an id is null or comes repeatedly."""
    found = settle(classes_of(docs, least, rare, sets).select("doc_id", "key", "root"), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "key")
    first = settle(found.groupBy("root").agg(F.min(order).alias("at")).select("at.doc_id", "at.key"), "kept")
    often = settle(found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("times")).filter("times > 1").select("doc_id"), "often")
    named = first.filter("doc_id IS NOT NULL")
    out = docs.join(named.join(often, "doc_id", "left_anti").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    own, kept_id, kept_key = (free_name(docs, name) for name in ("_key", "_kept_id", "_kept_key"))
    unclear = named.join(often, "doc_id", "left_semi").unionByName(first.filter("doc_id IS NULL")).select(F.col("doc_id").alias(kept_id), F.col("key").alias(kept_key))
    if unclear.isEmpty():
        return out
    rows = docs.join(often, "doc_id", "left_semi").select(docs.columns).unionByName(docs.filter("doc_id IS NULL")).withColumn(own, F.arrow_udf(text_key, "binary")("text"))
    rows = rows.join(unclear, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_key)), "left_semi")
    return out.unionByName(rows.dropDuplicates(["doc_id", own]).select(docs.columns))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document, by the idf of all shingles or by their sets."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), rare=0, sets=True)
