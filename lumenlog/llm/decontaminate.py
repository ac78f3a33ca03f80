"""Benchmark decontamination by a generalised suffix automaton of the normalised test items: each text's words run
through the automaton, which keeps the longest suffix that occurs in any item; words inside matches of window length are hit, and
spans or whole documents beyond the limits are removed.

Words are runs of digits, letters and code points from U+0080, A-Z lower-cased. A window is `window` consecutive words of an item; an
item of fewer words, but not none, is one window. An item's words become numbers of the items' vocabulary; a word outside it
resets the match, so only runs of known words, at least as long as the shortest window, pass through the automaton.

Defined results: a null or empty text or item has no words and no windows; an item id that comes repeatedly is one item if
its texts agree, else each text counts under the id; null item ids count as the empty id; repeated rows are judged each; an empty
table of items hits nothing, and an empty table of documents gives no rows; other columns are ignored; texts are read whole.

Items are read in order of their ids, and an automaton is built for each block of at most BLOCK_WORDS item words (or one longer item): so much the driver
holds and broadcasts at a time. A further block is a further pass over what the one before has written. No shuffle of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import free_name, give_back, pieces, settle, span_hashes, spans, table, text_bytes

WINDOW = 10
#: Item words of one automaton.
BLOCK_WORDS = 300_000
#: Words of a run that one lane of the vectorised scan takes on, besides the words that lead up to them.
LANE = 64


class SuffixAutomaton:
    """All substrings of several sequences of word numbers. States: link to the longest proper suffix in another state, length."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[int]) -> list[int]:
        """Adds a sequence; the states of its prefixes."""
        last, states = 0, []
        for word in words:
            last = self._extend(last, word)
            states.append(last)
        return states

    def _new(self, length: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state of p's longest word extended, as a copy of q that is that long."""
        copy = self._new(self.length[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if (q := self.next[last].get(word)) is not None:  # an earlier sequence has it
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        here, p = self._new(self.length[last] + 1, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = here
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[here] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return here


@dataclass
class Matcher:
    """The automaton of a block of items as arrays, and which items' windows end in a state.

    keys: state * len(vocabulary) + word, sorted, and the states they lead to. windows: (state, length) -> items whose window
    that is: the state that holds the window's words.
    """

    vocabulary: np.ndarray
    keys: np.ndarray
    targets: np.ndarray
    link: np.ndarray
    length: np.ndarray
    windows: dict[tuple[int, int], tuple[int, ...]]
    shortest: int
    window: int

    def run(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State and matched length (exact up to window) after each of the words; -1 stands for an unknown word."""
        n = len(words)
        state, length = np.zeros(n, np.int64), np.zeros(n, np.int64)
        known = words >= 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]])))
        first, last = edge[::2], edge[1::2]
        long_enough = last - first >= self.shortest
        first, last = first[long_enough], last[long_enough]
        if not len(first):
            return state, length
        # Lanes: LANE words of a run each, begun window - 1 words earlier; what a lane knows by then is exact up to window.
        lanes = -(-(last - first) // LANE)
        run = np.repeat(np.arange(len(first)), lanes)
        own = first[run] + LANE * (np.arange(len(run)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        stop = np.minimum(own + LANE, last[run])
        at = np.maximum(own - (self.window - 1), first[run])
        s, depth, size = np.zeros(len(run), np.int64), np.zeros(len(run), np.int64), len(self.vocabulary)
        live = np.arange(len(run))
        while len(live):
            word, here = words[at[live]], s[live]
            key = here * size + word
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            step = self.keys[k] == key
            fall = ~step & (here > 0)
            depth[live] = np.where(step, depth[live] + 1, np.where(fall, self.length[self.link[here]], 0))
            s[live] = np.where(step, self.targets[k], np.where(fall, self.link[here], 0))
            done = live[~fall]
            keep = done[at[done] >= own[done]]
            state[at[keep]], length[at[keep]] = s[keep], depth[keep]
            at[done] += 1
            live = live[at[live] < stop[live]]
        return state, length

    def ends(self, state: int, length: int) -> list[tuple[int, tuple[int, ...]]]:
        """The windows (length, items) that end where the automaton is in a state with a matched length."""
        out = []
        while state > 0:
            low = self.length[self.link[state]]
            out += [(n, self.windows[state, n]) for n in range(int(low) + 1, min(int(self.length[state]), length, self.window) + 1) if (state, n) in self.windows]
            state = int(self.link[state])
        return out


def normalised(texts: list[str]) -> list[np.ndarray]:
    """Hashes of each text's words."""
    data, offs = text_bytes(pa.array(texts, pa.large_string()))
    starts, ends, where = spans(data, offs)
    return np.split(span_hashes(data, starts, ends), where[1:-1]) if texts else []


def build_matchers(items: list[str], window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list[Matcher]:
    """Matchers over blocks of items; items are named by their place in the list."""
    hashed, out, k = normalised(items), [], 0
    while k < len(hashed):
        block, size = [], 0
        while k < len(hashed) and (not block or size + len(hashed[k]) <= block_words):
            if len(hashed[k]):
                block.append(k)
                size += len(hashed[k])
            k += 1
        if not block:
            continue
        vocabulary = np.unique(np.concatenate([hashed[i] for i in block]))
        automaton, windows, ended = SuffixAutomaton(), {}, []
        numbered = {i: np.searchsorted(vocabulary, hashed[i]).tolist() for i in block}
        for i in block:
            automaton.add(numbered[i])
        for i in block:  # once all are in, states no longer split
            state, words = 0, numbered[i]
            n = min(window, len(words))
            for at, word in enumerate(words):
                state = automaton.next[state][word]
                if at + 1 >= n:
                    while automaton.length[automaton.link[state]] >= n:
                        state = automaton.link[state]
                    ended.append((state, n, i))
        for state, n, i in ended:
            windows.setdefault((state, n), set()).add(i)
        triples = np.array([(s * len(vocabulary) + w, t) for s, moves in enumerate(automaton.next) for w, t in moves.items()], np.int64)
        triples = triples[np.argsort(triples[:, 0])]
        shortest = min(n for _, n in windows)
        out.append(Matcher(vocabulary, triples[:, 0], triples[:, 1], np.array(automaton.link).clip(0), np.array(automaton.length), {key: tuple(sorted(v)) for key, v in windows.items()}, shortest, window))
    return out


def find_hits(data: np.ndarray, offs: np.ndarray, matchers: list[Matcher]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[set[int]]]:
    """Words' starts, ends, offsets of the texts among them, which are hit, and the items found in each text."""
    starts, ends, where = spans(data, offs)
    hashes = span_hashes(data, starts, ends)
    hit, found = np.zeros(len(starts) + 1, np.int64), [set() for _ in range(len(offs) - 1)]
    for m in matchers:
        at = np.minimum(np.searchsorted(m.vocabulary, hashes), len(m.vocabulary) - 1)
        words = np.where(m.vocabulary[at] == hashes, at, -1)
        # A text's first word must not continue the text before: an unknown word between them.
        gaps = where[:-1]
        spread = np.insert(words, gaps, -1)
        place = np.arange(len(words)) + np.repeat(np.arange(1, len(where)), np.diff(where))
        state, length = m.run(spread)
        state, length = state[place], length[place]
        ended = np.flatnonzero(length >= m.shortest)
        owner, cache = np.searchsorted(where, ended, "right") - 1, {}
        for i, doc, s, n in zip(ended.tolist(), owner.tolist(), state[ended].tolist(), length[ended].tolist(), strict=True):
            key = s, min(n, m.window)
            if key not in cache:
                cache[key] = m.ends(*key)
            for size, names in cache[key]:
                hit[i + 1 - size] += 1
                hit[i + 1] -= 1
                found[doc].update(names)
    return starts, ends, where, np.cumsum(hit)[:-1] > 0, found


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[tuple[list[str], list[str]]]:
    """Ids (as strings) and texts of the items that have words, by id and text, in blocks of at most block_words words."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t")).distinct().orderBy("i", "t")
    ids, texts, size = [], [], 0
    for r in rows.toLocalIterator():
        if n := len(normalised([r.t])[0]):
            if ids and size + n > block_words:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(r.i)
            texts.append(r.t)
            size += n
    if ids:
        yield ids, texts


def _hit_scan(matchers, ids: list[str], last: bool):
    """For mapInArrow over doc_id, text and, after a first pass, what it found: spans of hit words (starts and ends in turn) and items. The last
    pass gives doc_id, n_words, n_hit, items; others hand on texts, spans and items."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            known = {c: batch.column(c).to_pylist() for c in ("spans", "items") if c in batch.schema.names}
            n_words, n_hit, marks, items = [], [], [], []
            for lo, _, d, o in pieces(data, offs):
                _, _, where, hit, found = find_hits(d, o, matchers.value if matchers else [])
                for k, names in enumerate(found):
                    own = hit[where[k] : where[k + 1]]
                    for a, b in zip(*(known["spans"][lo + k][i::2] for i in (0, 1)), strict=True) if known else ():
                        own[a:b] = True
                    n_words.append(len(own))
                    n_hit.append(int(own.sum()))
                    marks.append(None if last else np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]))))
                    items.append(sorted({ids[i] for i in names} | set(known["items"][lo + k] if known else ())))
            out = {"doc_id": batch.column("doc_id").cast(pa.int64()), "items": pa.array(items, pa.list_(pa.string()))}
            out |= {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64())} if last else {"text": batch.column("text"), "spans": pa.array(marks, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))
        give_back()

    return scan


def count_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as strings, sorted)."""
    share = docs.sparkSession.sparkContext.broadcast
    out, blocks = docs.select("doc_id", "text"), item_blocks(benchmark, block_words)
    block = next(blocks, None)
    while True:
        after = next(blocks, None)
        matchers = share(build_matchers(block[1], window, block_words)) if block else None
        scan, ids = _hit_scan, block[0] if block else []
        if after is None:
            return out.mapInArrow(scan(matchers, ids, True), "doc_id long, items array<string>, n_words long, n_hit long")
        out = settle(out.mapInArrow(scan(matchers, ids, False), "doc_id long, items array<string>, text string, spans array<long>"), "hits")
        matchers.destroy()
        block = after


def strip_hits(texts: list[bytes], matchers: list[Matcher]) -> tuple[list[bytes], list[int], list[int]]:
    """Texts without hit spans, how many words went, and how many there were. Texts that lost words are searched again, as a new window may have
    come together, until none is left."""
    texts, removed, total, todo = list(texts), [0] * len(texts), [0] * len(texts), range(len(texts))
    first = True
    while todo:
        data, again = np.frombuffer(b"".join(texts[k] for k in todo), np.uint8), []
        offs = np.concatenate([[0], np.cumsum([len(texts[k]) for k in todo])])
        starts, ends, where, hit, _ = find_hits(data, offs, matchers)
        sums = np.concatenate([[0], np.cumsum(hit)])
        for j, k in enumerate(todo):
            a, b = where[j], where[j + 1]
            if first:
                total[k] = int(b - a)
            if sums[b] == sums[a]:
                continue
            removed[k] += int(sums[b] - sums[a])
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].view(np.int8), [0]])))
            raw, parts, at = texts[k], [], 0
            for begin, end in zip(edge[::2], edge[1::2], strict=True):
                parts.append(raw[at : starts[a + begin] - offs[j]])
                at = int(ends[a + end - 1] - offs[j])
                if parts[-1][-1:].isspace() or not parts[-1]:
                    at += raw[at : at + 1].isspace()
            texts[k] = b"".join([*parts, raw[at:]])
            again.append(k)
        todo, first = again, False
    return texts, removed, total


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the hit spans; documents of which more than max_coverage of the words are hit go altogether.

    A span reaches from its first hit word to its last and takes one white space along; texts without hits stay as they are, and in the result
    nothing is hit any more. Adds removed_words (with `_` behind where docs have it). n_chars, where docs have it, follows the text.
    """
    share = docs.sparkSession.sparkContext.broadcast
    removed, words = free_name(docs, "removed_words"), free_name(docs, "_words")
    found = free_name(docs, "_clean")

    def passed(out: DataFrame, texts: list[str]) -> DataFrame:
        matchers = share(build_matchers(texts, window, block_words))

        def clean(column: pa.Array) -> pa.Array:
            data, offs = text_bytes(column)
            new, gone, total = [], [], []
            for lo, hi, d, o in pieces(data, offs):
                raw = d.tobytes()
                for all_, part in zip((new, gone, total), strip_hits([raw[o[k] : o[k + 1]] for k in range(hi - lo)], matchers.value), strict=True):
                    all_ += part
            give_back()
            return pa.StructArray.from_arrays([pa.array([x.decode() for x in new], pa.string()), pa.array(gone, pa.int64()), pa.array(total, pa.int64())], ["text", "removed", "total"])

        # Not deterministic for the optimizer alone: it would else evaluate the texts once more for the filter.
        cleaned = F.arrow_udf(clean, "struct<text: string, removed: long, total: long>").asNondeterministic()
        here = out.withColumn(found, cleaned("text"))
        changed = F.col(f"{found}.removed") > 0
        here = here.withColumn("text", F.when(changed, F.col(f"{found}.text")).otherwise(F.col("text")))
        return here.withColumn(removed, F.col(removed) + F.col(f"{found}.removed")).withColumn(words, F.coalesce(words, f"{found}.total")).drop(found)

    out = docs.withColumn(removed, F.lit(0).cast("long")).withColumn(words, F.lit(None).cast("long"))
    before, many = 0, False
    while True:
        for _, texts in item_blocks(benchmark, block_words):
            out, many = settle(out, "cleaned") if many else out, True
            out = passed(out, texts)
        several = next(islice(item_blocks(benchmark, block_words), 1, None), None) is not None
        if not several:
            break
        out = settle(out, "cleaned")  # what one block's removals bring together may be another's
        if (now := out.agg(F.sum(removed)).first()[0] or 0) == before:
            break
        before = now
    out = out.filter(F.col(removed) <= F.coalesce(words, F.lit(0)) * max_coverage).drop(words)
    return out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else out


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's hits."""
    found = count_hits(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP6_SQL = r"""
WITH i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, w, len(w) AS n
  FROM (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0
), g AS (
  SELECT DISTINCT item_id, least(n, 10) AS size, array_to_string(w[k : k + least(n, 10) - 1], ' ') AS gram
  FROM i, unnest(range(1, greatest(n - 8, 2))) AS t(k)
), d AS (
  SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), s AS (SELECT DISTINCT size FROM g),
x AS (
  SELECT r, k, size, array_to_string(w[k : k + size - 1], ' ') AS gram
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, s WHERE len(w) >= size)
), m AS (
  SELECT r, k, x.size, item_id FROM x JOIN g ON x.size = g.size AND x.gram = g.gram
), h AS (
  SELECT r, count(DISTINCT k + o) AS n_hit FROM m, unnest(range(0, size)) AS t(o) GROUP BY r
), e AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN e USING (r)
"""
