"""Media columns by content-defined payload chunking: a rolling gear hash cuts media into chunks, one copy of each chunk is kept by
digest, and ordered chunk lists, joined with the chunks, give the media back, verified by digest. Chunks that an earlier store holds are left out by
a join; among new ones an aggregate by digest, the shuffle that a join would take, picks the copy. Chunks are compressed with a dictionary that is
trained on a bounded sample of the texts (its beginnings; the dictionary changes the sizes of stored chunks only). Texts are cut twice, for
the lists and for the chunks, as writing both at once would keep every task's chunks on disk before they are deduplicated.

A text's payload (its UTF-8 bytes, padded with zeros to a positive multiple of 64) is stored as the samples of an 8-bit mono WAV
file; the file is what is chunked. Where equal chunks lie in different media, one copy is kept; equal media share one chunk list.

Defined results: a null text is the empty text, whose payload is 64 zeros; repeated rows share their media; a null id is kept
as it is; an empty table gives no rows; other columns are ignored; texts are read whole. Media whose bytes don't come back as they
were stored fail the query.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import SALTS, join_hot, least_hashes, settle, table, text_array

#: Least, usual and most bytes of a chunk; a cut is where the gear hash's top bits are all zero.
LEAST, USUAL, MOST = 4096, 16384, 65536
#: Texts that the compression dictionary is trained on, at most, their first bytes that it sees, and its own bytes.
SAMPLE_TEXTS, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 8192, 1 << 16
#: The gear table: one 32-bit number for each byte, from a fixed rule.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([k])).digest()[:4], "little") for k in range(256)], np.uint32)
RATE = 8000


def to_payload(text: str) -> tuple[bytes, int]:
    """The padded payload of a text, and the bytes it had."""
    raw = text.encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64)), len(raw)


def to_media(payload: bytes) -> bytes:
    """A WAV file with the payload as 8-bit mono samples."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def from_media(media: bytes) -> bytes:
    """The samples of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def cuts(media: bytes, least: int = LEAST, usual: int = USUAL, most: int = MOST) -> list[int]:
    """Ends of the chunks. The gear hash h = 2 h + gear[byte] of 32 bits depends on the last 32 bytes, so it is the sum of shifted
    table values, made by doubling; cuts therefore move with the content."""
    n = len(media)
    if n <= least:
        return [n]
    h = GEAR[np.frombuffer(media, np.uint8)]
    for width in (1, 2, 4, 8, 16):
        shifted = h[:-width] << np.uint32(width)
        h = h.copy()
        h[width:] += shifted
    places = np.flatnonzero(h >> np.uint32(33 - usual.bit_length()) == 0) + 1
    out, at = [], 0
    while n - at > least:
        k = int(np.searchsorted(places, at + least))
        end = min(int(places[k]) if k < len(places) else n, at + most, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def media_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over doc_id, text: each document's medium, its size, its chunk list, and salt (rows of a task in turn)."""
    done = 0
    for batch in batches:
        out = {k: [] for k in ("n_bytes", "media", "size", "list")}
        for text in text_array(batch.column("text")).to_pylist():
            payload, n = to_payload(text)
            media = to_media(payload)
            ends = cuts(media)
            names = [hashlib.sha256(media[a:b]).digest() for a, b in zip([0, *ends], ends, strict=False)]
            for k, v in zip(out, (n, names[0] if len(names) == 1 else hashlib.sha256(media).digest(), len(media), names), strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(out["n_bytes"], pa.int64()), pa.array(out["media"], pa.binary()), pa.array(out["size"], pa.int64()), pa.array(out["list"], pa.list_(pa.binary())), pa.array(np.arange(done, done + len(batch)) % SALTS, pa.int32())], ["doc_id", "n_bytes", "media", "size", "list", "salt"])
        done += len(batch)


def _chunks(dictionary: bytes):
    """For mapInArrow over text: digest, data (compressed), part (whether of a medium of several chunks), once a task for the chunks of late."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, sent = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None), set()
        for batch in batches:
            out = []
            for text in text_array(batch.column("text")).to_pylist():
                media = to_media(to_payload(text)[0])
                ends = cuts(media)
                for a, b in zip([0, *ends], ends, strict=False):
                    digest = hashlib.sha256(media[a:b]).digest()
                    if (mark := (digest[:8], len(ends) > 1)) not in sent:
                        if len(sent) >= 1 << 18:  # what is sent again is dropped by the join
                            sent.clear()
                        sent.add(mark)
                        out.append((digest, pack.compress(media[a:b]), len(ends) > 1))
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.bool_()))], ["digest", "data", "part"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.bool_()))], ["digest", "data", "part"])

    return chunks


def train_dictionary(docs: DataFrame, rows: int = SAMPLE_TEXTS) -> bytes:
    """A compression dictionary from the beginnings of at most rows texts, chosen by a hash of the id; empty where they are too few."""
    sample = least_hashes(docs.select("doc_id", F.substring("text", 1, SAMPLE_BYTES).alias("text")), F.xxhash64("doc_id"), rows).filter("text <> ''")
    texts = [r["text"].encode() for r in sample.collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes() if len(texts) >= 100 else b""
    except zstandard.ZstdError:  # too little or too uniform
        return b""


def store_texts(docs: DataFrame, dictionary: bytes, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables: media (doc_id, n_bytes, media, size, list: the ordered chunk list of each document) and chunks (digest, data, and whether it is part of a
    medium, or a whole one), one of each digest. known: an earlier store's chunks, compressed with the same dictionary, which aren't stored again."""
    docs = docs.select("doc_id", "text")
    lists = settle(docs.mapInArrow(media_lists, "doc_id long, n_bytes long, media binary, size long, list array<binary>, salt int"), "media")
    sent = docs.select("text").mapInArrow(_chunks(dictionary), "digest binary, data binary, part boolean")
    if known is not None:
        sent = sent.join(known.select("digest"), "digest", "left_anti")
    return lists, settle(sent.groupBy("digest").agg(F.first("data").alias("data"), F.bool_or("part").alias("part"), F.bool_or(~F.col("part")).alias("whole")), "chunks")


def _tell(media: bytes, digest: bytes) -> tuple:
    """Payload size, digest, tail checksum and features of media read back."""
    if hashlib.sha256(media).digest() != digest:
        raise ValueError(f"media {digest.hex()} don't come back as stored")
    payload = from_media(media)
    samples = np.frombuffer(payload, np.uint8)
    centred = samples.astype(np.int16) - 128
    crossings = int(np.count_nonzero((centred[1:] < 0) != (centred[:-1] < 0)))
    feature = f"{len(samples) / RATE:.4f}s mean={samples.mean():.3f} rms={np.sqrt((centred.astype(np.float32) ** 2).mean()):.3f} zc={crossings} chunks={len(cuts(media))}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]) & 0xFFFFFFFF, feature


TOLD = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


def _told(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*((digest, *_tell(media, digest)) for digest, media in found), strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)], ["media", "payload_bytes", "payload_sha256", "tail_crc32", "feature"])


def _unpacker(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _read_single(dictionary: bytes):
    """For mapInArrow over chunks that are whole media, whose digest is then the medium's."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _unpacker(dictionary)
        for batch in batches:
            yield _told([(d, unpack.decompress(x)) for d, x in zip(batch.column("digest").to_pylist(), batch.column("data").to_pylist(), strict=True)])

    return read


def _read_several(dictionary: bytes):
    """For mapInArrow over media and their chunks in order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _unpacker(dictionary)
        for batch in batches:
            yield _told([(d, b"".join(unpack.decompress(x["data"].as_py()) for x in parts)) for d, parts in zip(batch.column("media").to_pylist(), batch.column("parts"), strict=True)])

    return read


def read_texts(lists: DataFrame, chunks: DataFrame, dictionary: bytes) -> DataFrame:
    """Each medium's payload figures, from its chunks in order. Media of one chunk are read where it lies; only the chunks of others travel."""
    single = chunks.filter("whole").select("digest", "data").mapInArrow(_read_single(dictionary), TOLD)
    several = lists.filter(F.size("list") > 1).dropDuplicates(["media"]).select("media", F.posexplode("list").alias("place", "digest"))
    placed = several.join(chunks.filter("part").select("digest", "data"), "digest").select("media", F.struct("place", "data").alias("part"))
    many = placed.groupBy("media").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return single.unionByName(many.mapInArrow(_read_several(dictionary), TOLD))


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, all read back from the chunks."""
    dictionary = train_dictionary(docs)
    lists, chunks = store_texts(docs, dictionary)
    told = settle(read_texts(lists, chunks, dictionary), "told").dropDuplicates(["media"])
    return join_hot(lists.select("doc_id", "n_bytes", "media", F.col("size").alias("media_bytes"), "salt"), told, ["media"], "salt").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.lower(F.hex("media")).alias("media_sha256"), "feature")


def op5_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text through the chunk store."""
    return media_columns(table(spark, sf_dir, "documents", "doc_id", "text"))
