"""Toxicity: gradient-boosted trees over dense features of a text (lexicon densities, second-person proximity, capitals,
punctuation and obfuscation rates), with isotonic calibration of out-of-fold margins.

Two lexicons: seed words of insult, and word beginnings and words learned from the labelled sample (those that are far likelier
in toxic documents). Training rows get their densities of the learned lexicon from one that was learned without them, and the margins that
calibrate come from folds whose rows neither the lexicons nor the trees have seen.

Defined results: null and empty texts have all features 0; texts are read whole; repeated rows are scored each; an
empty table gives no rows; without labels of both classes every score is the share of label 1 (0.5 without any); other
columns, labels included, are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import IS_DARK, IS_WORD, LOWER, RunHasher, free_name, give_back, held_out, pieces, span_hashes, spans, table, text_bytes, word_hash
from lumenlog.llm.learning import SAMPLE_ROWS, Trees, boost, folds, isotonic, labelled_sample

#: Texts with a score from here on count as toxic.
THRESHOLD = 0.3
#: Seed words of insult, by language.
INSULTS = (
    "idiot idiots idiotic moron morons moronic stupid stupidity dumb loser losers scum trash garbage worthless pathetic disgusting clown clowns fool fools imbecile jerk "
    "vermin filth filthy hate hateful hated kill die shut ugly retard retarded bastard crap damn hell freak creep cretin coward liar pig pigs rat rats swine parasite parasites useless "
    "connard idiote imbécile salaud stupide ordure dummkopf idioten arschloch abschaum dreck blödmann estúpido estúpida imbécil basura asqueroso cretino inútil"
).split()
SECOND_PERSON = "you your yours yourself u ur tu toi te ton ta tes vous votre vos du dich dir dein deine ihr euch usted ustedes".split()
#: Words this near to a lexicon word count as near.
NEAR = 5

#: Folds look-alike characters to letters, for obfuscated words such as 1d10t or s+upid.
_LOOKS = LOWER.copy()
for _a, _b in zip("013457@$!+|", "oieastasitl", strict=True):
    _LOOKS[ord(_a)] = ord(_b)
#: Bytes of tokens that may hide a word: letters, digits, look-alikes.
_HIDING = IS_WORD.copy()
_HIDING[[ord(c) for c in "@$!+|"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = IS_DARK & ~IS_WORD

#: Bytes of word beginnings in the learned lexicon; 0 stands for whole words.
BEGINNINGS = (4, 6, 7, 0)
#: Log-odds and least share of the toxic rows (and least rows) that a beginning needs.
LEARN_ODDS, LEARN_SHARE, LEARN_ROWS = 3.0, 0.01, 4

FEATURES = ("words", "insults", "insult_density", "kinds", "hidden_density", "second_person", "near_density", "upper", "shouted", "punctuation", "exclamations", "digits_inside")


def _members(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place in the sorted known hashes, or -1."""
    at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
    return np.where(known[at] == hashes, at, -1) if len(known) else np.full(len(hashes), -1)


def _units(hasher: RunHasher, starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words have a beginning of size bytes, and its 32-bit hashes."""
    long_enough = np.flatnonzero(ends - starts >= size)
    stop = starts[long_enough] + size if size else ends
    return long_enough, ((hasher(starts[long_enough], stop) ^ np.uint64(0x51ED270B * (size + 1))) >> np.uint64(32)).astype(np.uint32)


class Lexicon:
    """Sorted hashes of the seed words, made on each executor from the words, and of the learned beginnings by their size."""

    def __init__(self, learned: list[np.ndarray] | None = None, insults: list[str] = INSULTS, second: list[str] = SECOND_PERSON):
        self.insults, self.second = np.unique(word_hash(insults)), np.unique(word_hash(second))
        self.learned = learned

    def dense(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """A row of FEATURES for each text."""
        n = len(offs) - 1
        starts, ends, where = spans(data, offs, IS_WORD)
        owner = np.repeat(np.arange(n), np.diff(where))
        words = np.diff(where).astype(float)
        count = lambda mask, by=owner: np.bincount(by, weights=mask, minlength=n)
        hasher = RunHasher(data)
        hashes = hasher(starts, ends)
        which = _members(hashes, self.insults)
        hit, second = which >= 0, _members(hashes, self.second) >= 0
        pairs = np.unique(owner[hit] * (len(self.insults) + 1) + which[hit])
        kinds = np.bincount(pairs // (len(self.insults) + 1), minlength=n)
        # A lexicon word with a second-person word within NEAR words of the same text.
        you = np.flatnonzero(second)
        near = np.zeros(len(starts), bool)
        if len(you):
            at = np.flatnonzero(hit)
            for shift in (-1, 0):
                k = np.clip(np.searchsorted(you, at) + shift, 0, len(you) - 1)
                near[at[(np.abs(you[k] - at) <= NEAR) & (owner[you[k]] == owner[at])]] = True
        # Tokens that read as a lexicon word once look-alikes are letters, but not as they stand.
        hs, he, hw = spans(data, offs, _HIDING)
        hidden = np.zeros(n)
        if len(hs):
            odd = np.concatenate([[0], np.cumsum(~_LETTER[data])])
            mixed = (odd[he] - odd[hs] > 0) & _LETTER[data[hs]]
            ho = np.repeat(np.arange(n), np.diff(hw))[mixed]
            hidden = np.bincount(ho, weights=_members(span_hashes(data, hs, he, _LOOKS)[mixed], self.insults) >= 0, minlength=n)
        sums = lambda member: (lambda c: (c[offs[1:]] - c[offs[:-1]]).astype(float))(np.concatenate([[0], np.cumsum(member[data])]))
        letters, chars = np.maximum(sums(_LETTER), 1), np.maximum(np.diff(offs), 1)
        upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        size = ends - starts
        shouted = (upper[ends] - upper[starts] == size) & (size > 2)
        inside = (digits[ends] - digits[starts] > 0) & (digits[ends] - digits[starts] < size)
        per = np.maximum(words, 1)
        bang = np.zeros(256, bool)
        bang[33] = True
        hits = count(hit)
        out = [np.log1p(words), np.minimum(hits, 20), hits / per, np.minimum(kinds, 20), hidden / per, count(second) / per, count(near) / per, sums(_UPPER) / letters, count(shouted) / per, sums(_PUNCT) / chars, sums(bang) / chars, count(inside) / per]
        for known, size in zip(self.learned or [], BEGINNINGS, strict=False):
            at, units = _units(hasher, starts, ends, size)
            found = np.bincount(owner[at][_members(units, known) >= 0], minlength=n)
            out += [np.minimum(found, 20), found / per]
        return np.stack(out, 1)

    def units(self, data: np.ndarray, offs: np.ndarray) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """For each text and each of BEGINNINGS: the distinct units and how often they come."""
        starts, ends, where = spans(data, offs, IS_WORD)
        hasher, out = RunHasher(data), [[] for _ in range(len(offs) - 1)]
        for size in BEGINNINGS:
            at, units = _units(hasher, starts, ends, size)
            bounds = np.searchsorted(at, where)
            for k, found in enumerate(out):
                found.append(np.unique(units[bounds[k] : bounds[k + 1]], return_counts=True))
        return out

    def rows(self, texts: pa.Array) -> np.ndarray:
        data, offs = text_bytes(texts)
        found = [self.dense(d, o) for _, _, d, o in pieces(data, offs)]
        return np.concatenate(found) if found else np.zeros((0, len(FEATURES) + 2 * len(self.learned or [])))


@dataclass
class ToxicModel:
    trees: Trees
    learned: list[np.ndarray]
    margins: np.ndarray  # of the calibration's knots
    chances: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.margin(x), self.margins, self.chances)


Units = list[tuple[np.ndarray, np.ndarray]]  # of one text, for each of BEGINNINGS


def learn(units: list[Units], y: np.ndarray) -> list[np.ndarray]:
    """Units far likelier in label 1 than in label 0, by their share of documents; sorted, for each of BEGINNINGS."""
    out, up, down = [], max(int(y.sum()), 1), max(int(len(y) - y.sum()), 1)
    for j in range(len(BEGINNINGS)):
        seen = [np.concatenate([u[j][0] for u, label in zip(units, y, strict=True) if label == k] or [np.zeros(0, np.uint32)]) for k in (0, 1)]
        ids, n = np.unique(seen[1], return_counts=True)
        clean = np.sort(seen[0])
        other = np.searchsorted(clean, ids, "right") - np.searchsorted(clean, ids, "left")
        odds = np.log((n + 0.5) / (up + 1)) - np.log((other + 0.5) / (down + 1))
        out.append(ids[(odds >= LEARN_ODDS) & (n >= max(LEARN_ROWS, LEARN_SHARE * up))])
    return out


def learned_features(units: list[Units], words: np.ndarray, learned: list[np.ndarray]) -> np.ndarray:
    """What Lexicon.dense adds for a learned lexicon, from the texts' units. words: number of words of each text."""
    x = np.zeros((len(units), 2 * len(BEGINNINGS)))
    for i, text in enumerate(units):
        for j, (ids, n) in enumerate(text):
            found = n[_members(ids, learned[j]) >= 0].sum()
            x[i, 2 * j : 2 * j + 2] = min(found, 20), found / max(words[i], 1)
    return x


def fit(x: np.ndarray, units: list[Units], y: np.ndarray) -> ToxicModel:
    """Trees on all rows, calibrated by the margins of three folds' held-out rows."""
    if len(set(y.tolist())) < 2:
        p = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return ToxicModel(boost(x[:0], y[:0]), [], np.array([0.0]), np.array([p]))
    fold, words = folds(len(y)), np.expm1(x[:, 0]).round()
    learned = lambda rows: learn([units[i] for i in rows], y[rows])
    told = lambda rows, lexicon: learned_features([units[i] for i in rows], words[rows], lexicon)

    def crossed(rows: np.ndarray) -> np.ndarray:
        """All features of rows, those of the learned lexicon from one that was learned from rows of other folds."""
        extra, part = np.zeros((len(rows), 2 * len(BEGINNINGS))), folds(len(rows))
        for k in range(3):
            extra[part == k] = told(rows[part == k], learned(rows[part != k]))
        return np.concatenate([x[rows], extra], 1)

    margin = np.zeros(len(y))
    for k in range(3):  # nested: nothing that scores a fold, lexicon or trees, has seen it
        rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        margin[own] = boost(crossed(rest), y[rest]).margin(np.concatenate([x[own], told(own, learned(rest))], 1))
    every = np.arange(len(y))
    return ToxicModel(boost(crossed(every), y), learned(every), *isotonic(margin, y))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lexicon = Lexicon()
    for batch in batches:
        data, offs = text_bytes(batch.column("text"))
        x, ids, counts = lexicon.rows(batch.column("text")), [], []
        for _, _, d, o in pieces(data, offs):
            for text in lexicon.units(d, o):
                ids.append([u.view(np.int32) for u, _ in text])
                counts.append([np.minimum(n, 1 << 30).astype(np.int32) for _, n in text])
        kind = pa.list_(pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("label").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64())), pa.array(ids, kind), pa.array(counts, kind)], ["doc_id", "label", "features", "units", "counts"])
    give_back()


def train_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ToxicModel:
    """Fits to at most rows labelled, not held-out documents; their features are made on the executors."""
    sample = labelled_sample(docs, labels, "toxic", rows).mapInArrow(_feature_rows, "doc_id long, label int, features array<double>, units array<array<int>>, counts array<array<int>>").toArrow()
    order = sorted(range(len(sample)), key=lambda i, key=list(zip(sample["doc_id"].to_pylist(), sample["label"].to_pylist(), sample["features"].to_pylist(), strict=True)): key[i])
    x = np.array([sample["features"][i].as_py() for i in order], float).reshape(len(order), len(FEATURES))
    of = lambda name, i: [np.asarray(sample[name][i].values[j].values, np.int32) for j in range(len(BEGINNINGS))]
    units = [list(zip((u.view(np.uint32) for u in of("units", i)), of("counts", i), strict=True)) for i in order]
    model = fit(x, units, np.array([sample["label"][i].as_py() for i in order], float))
    del sample, order, x, units, of
    give_back()  # the driver's memory, for the steps that come after
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted (1 from the threshold on), with `_` behind where docs have such columns; map-only."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        found = pa.array(model.scores(Lexicon(model.learned).rows(texts)), pa.float64())
        give_back()
        return found

    at, say = free_name(docs, "score"), free_name(docs, "predicted")
    return docs.withColumn(at, score("text")).withColumn(say, (F.col(at) >= threshold).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every whole text."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = train_toxicity(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
