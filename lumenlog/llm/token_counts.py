"""Token counts by separator scan: a flat token file is a run of token ids, each document closed by an end-of-document id,
without an index. Blocks of a file are searched for separators at once, and what a block begins or leaves open is stitched to its neighbours
by a prefix scan over the blocks' summaries: first inside ranges of blocks, then over the ranges, so no task gets a file's blocks whole.

A file comes as rows (file, block, tokens): its bytes cut into blocks of any size that is a multiple of the id's width, so documents
run across blocks. read_token_files makes such rows of raw files; write_token_files tokenises texts into them.

Defined results: an empty text, or a null one, is a document of 0 tokens; what stands after a file's last separator is a document
that isn't closed, with closed false, if it has tokens; empty blocks and empty files have none; repeated rows are documents each;
the separator's own text inside a document is ordinary text; an empty table gives no rows; texts are read whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlog.llm.common import settle, table, text_array

#: The public byte-level vocabulary of 50,256 tokens; the id after the last is free and closes documents.
TOKENIZER, SEPARATOR = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256
#: Bytes of a block, and documents of a file.
BLOCK_BYTES, FILE_ROWS = 1 << 18, 1 << 14
#: Blocks of a file that one task scans in order.
RANGE_BLOCKS = 4096


@lru_cache(1)
def tokenizer(path: str, pattern: str | None = None):
    """The byte-pair tokenizer of a ranks file, which each executor must have at that path; pattern splits texts (the public vocabularies' own one by default)."""
    import tiktoken

    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, path: str = TOKENIZER, separator: int = SEPARATOR, block_bytes: int = BLOCK_BYTES, pattern: str | None = None) -> DataFrame:
    """Tokenises doc_id, text into flat files of 16-bit ids, one or more for each task: rows (file, block, tokens) and, for
    each file, (file, -1, doc_ids) with the ids in order, which the files themselves don't hold."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, task, number = tokenizer(path, pattern).encode_ordinary, TaskContext.get().partitionId(), 0

        def rows(file: str, first: int, blocks: list[bytes], ids: list | None) -> pa.RecordBatch:
            names = [*range(first, first + len(blocks)), *([-1] if ids is not None else [])]
            return pa.RecordBatch.from_arrays([pa.array([file] * len(names), pa.string()), pa.array(names, pa.int64()), pa.array([*blocks, *([None] if ids is not None else [])], pa.binary()), pa.array([None] * len(blocks) + ([ids] if ids is not None else []), pa.list_(pa.int64()))], ["file", "block", "tokens", "doc_ids"])

        tail, ids, block = bytearray(), [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").cast(pa.int64()).to_pylist(), text_array(batch.column("text")).to_pylist(), strict=True):
                tail += np.array([*encode(text), separator], "<u2").tobytes()
                ids.append(doc_id)
                if len(tail) >= 8 * block_bytes:
                    whole = len(tail) // block_bytes
                    yield rows(f"{task}-{number}", block, [bytes(tail[k * block_bytes : (k + 1) * block_bytes]) for k in range(whole)], None)
                    tail, block = tail[whole * block_bytes :], block + whole
                if len(ids) == FILE_ROWS:
                    yield rows(f"{task}-{number}", block, [bytes(tail[k : k + block_bytes]) for k in range(0, len(tail), block_bytes)], ids)
                    tail, ids, block, number = bytearray(), [], 0, number + 1
        if ids:
            yield rows(f"{task}-{number}", block, [bytes(tail[k : k + block_bytes]) for k in range(0, len(tail), block_bytes)], ids)

    return docs.select("doc_id", "text").mapInArrow(write, "file string, block long, tokens binary, doc_ids array<long>")


def read_token_files(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Raw token files (each below 2 GiB, as such shards are, and as a row is) as rows (file, block, tokens)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                raw = memoryview(content.as_buffer())
                for k in range(0, len(raw), 16 * block_bytes):
                    blocks = [bytes(raw[a : a + block_bytes]) for a in range(k, min(k + 16 * block_bytes, len(raw)), block_bytes)]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(blocks), pa.string()), pa.array(range(k // block_bytes, k // block_bytes + len(blocks)), pa.int64()), pa.array(blocks, pa.binary())], ["file", "block", "tokens"])

    files = spark.read.format("binaryFile").load(path).filter("length > 0").select(F.col("path").alias("file"), "content")
    return files.mapInArrow(cut, "file string, block long, tokens binary")


def _scan(separator: int, width: int):
    """For mapInArrow: n tokens, and the places of separators in the block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, places = [], []
            for raw in batch.column("tokens"):
                ids = np.frombuffer(raw.as_buffer() or b"", f"<u{width}")
                sizes.append(len(ids))
                places.append(np.flatnonzero(ids == separator))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(sizes, pa.int64()), pa.array(places, pa.list_(pa.int64()))], ["file", "block", "n", "places"])

    return scan


def count_documents(blocks: DataFrame, separator: int = SEPARATOR, width: int = 2, range_blocks: int = RANGE_BLOCKS) -> DataFrame:
    """file, ordinal (from 0), n_tokens, closed of every document of the files, from (file, block, tokens)."""
    found = settle(blocks.select("file", "block", "tokens").mapInArrow(_scan(separator, width), "file string, block long, n long, places array<long>"), "scan")
    summary = found.select("file", "block", F.expr(f"block div {range_blocks}").alias("part"), "n", F.size("places").cast("long").alias("ends"), F.try_element_at("places", F.lit(-1)).alias("last"))
    # Prefix scan: tokens and separators before the block, and where the last separator before it stands, in the range and then in the file.
    before = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = summary.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("first", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    inner = settle(inner.withColumn("at", F.col("start") + F.col("last")).withColumn("open", F.max("at").over(before)), "inner")
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = inner.groupBy("file", "part").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.max("at").alias("at"))
    ranges = ranges.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("first", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    ranges = settle(ranges.withColumn("at", F.col("start") + F.col("at")).withColumn("open", F.coalesce(F.max("at").over(before), F.lit(-1))), "ranges")
    outer = ranges.select("file", "part", F.col("start").alias("range_start"), F.col("first").alias("range_first"), F.col("open").alias("range_open"))
    placed = inner.join(outer, ["file", "part"]).select("file", "block", (F.col("range_start") + F.col("start")).alias("start"), (F.col("range_first") + F.col("first")).alias("first"), F.coalesce(F.col("range_start") + F.col("open"), F.col("range_open")).alias("open"))
    joined = found.select("file", "block", "places").join(placed, ["file", "block"])
    ends = F.transform("places", lambda p: p + F.col("start"))
    starts = F.concat(F.array("open"), F.slice(ends, 1, F.greatest(F.size("places") - 1, F.lit(0))))
    docs = joined.filter(F.size("places") > 0).select("file", "first", F.posexplode(F.zip_with(ends, starts, lambda e, s: e - s - 1)).alias("k", "n_tokens"))
    closed = docs.select("file", (F.col("first") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed"))
    whole = ranges.groupBy("file").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.coalesce(F.max("at"), F.lit(-1)).alias("at"))
    rest = whole.select("file", F.col("ends").alias("ordinal"), (F.col("n") - F.col("at") - 1).alias("n_tokens"), F.lit(False).alias("closed")).filter("n_tokens > 0")
    return closed.unionByName(rest)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens of every document, by scanning the token files that its text was written to."""
    files = settle(write_token_files(table(spark, sf_dir, "documents", "doc_id", "text")), "tokens")
    counts = count_documents(files.filter("block >= 0").select("file", "block", "tokens"))
    ids = files.filter("block < 0").select("file", F.posexplode("doc_ids").alias("ordinal", "doc_id"))
    return ids.join(counts, (ids["file"] == counts["file"]) & (ids["ordinal"] == counts["ordinal"]), "left").select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), "closed")
