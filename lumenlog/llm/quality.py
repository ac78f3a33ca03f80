"""Quality classifier: naive Bayes support vectors. Indicators of n-grams are scaled by the classes' log-count ratios, and a linear
hinge-loss model is fitted to them by dual coordinate descent; Platt scaling of out-of-fold margins gives the score.

The n-grams are byte trigrams, and 1- to 3-grams of the shapes of white-space tokens (case, last character, length, whether the
token repeats the one before), hashed to 2**16 features. A text's indicator vector is scaled by 1 / sqrt(its features).

Defined results: null and empty texts have no features and get the bias's score; texts are read whole; repeated rows are scored
each; an empty table gives no rows; without labels of both classes every score is the share of label 1 (0.5 without any);
other columns, labels included, are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import IS_DARK, free_name, give_back, held_out, pieces, span_hashes, spans, table, text_bytes
from lumenlog.llm.learning import SAMPLE_ROWS, folds, hinge_dual, labelled_sample, platt, sigmoid

DIMS = 1 << 16
#: Texts with a score from here on count as good.
THRESHOLD = 0.7

_CASE = np.full(256, 3, np.uint32)  # other
_CASE[97:123] = _CASE[128:] = 0
_CASE[65:91] = 1
_CASE[48:58] = 2
_LAST = np.full(256, 4, np.uint32)
_LAST[97:123] = _LAST[65:91] = _LAST[128:] = 0
_LAST[48:58], _LAST[46], _LAST[44] = 1, 2, 3


def _bucket(code: np.ndarray, salt: int) -> np.ndarray:
    return ((code.astype(np.uint64) + np.uint64(salt << 32)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and feature ids, each pair once, ordered. For at most 2**16 - 1 texts at a time."""
    found = []
    doc = np.repeat(np.arange(len(offs) - 1, dtype=np.uint32), np.diff(offs))
    if len(data) > 2:
        b = data.astype(np.uint32)
        same = doc[2:] == doc[:-2]
        found.append((doc[2:] << np.uint32(16) | _bucket(b[:-2] << 16 | b[1:-1] << 8 | b[2:], 1).astype(np.uint32))[same])
    starts, ends, where = spans(data, offs, IS_DARK)
    if len(starts):
        owner = np.repeat(np.arange(len(offs) - 1, dtype=np.uint32), np.diff(where))
        hashes = span_hashes(data, starts, ends)
        again = np.zeros(len(starts), np.uint32)
        again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        second = np.where(ends - starts > 1, _CASE[data[np.minimum(starts + 1, ends - 1)]], 0).astype(np.uint32)
        size = np.searchsorted([2, 4, 7, 11, 16], ends - starts, "right").astype(np.uint32)
        shape = (((_CASE[data[starts]] * 4 + second) * 5 + _LAST[data[ends - 1]]) * 2 + again) * 6 + size
        for n in (1, 2, 3):
            if len(shape) >= n:
                code, same = shape[: len(shape) - n + 1].astype(np.uint64), owner[n - 1 :] == owner[: len(owner) - n + 1]
                for k in range(1, n):
                    code = code * np.uint64(1009) + shape[k : len(shape) - n + 1 + k].astype(np.uint64)
                found.append((owner[n - 1 :] << np.uint32(16) | _bucket(code, 1 + n).astype(np.uint32))[same])
    keys = np.concatenate(found) if found else np.zeros(0, np.uint32)
    keys.sort()
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys
    return (keys >> np.uint32(16)).astype(np.int64), (keys & np.uint32(0xFFFF)).astype(np.int64)


@dataclass
class QualityModel:
    """weights: of features, already scaled by the log-count ratios, in float32; bias; a and b of Platt's sigmoid."""

    weights: np.ndarray
    bias: float
    a: float
    b: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        data, offs = text_bytes(texts)
        out = []
        for lo, hi, d, o in pieces(data, offs):
            doc, feature = features(d, o)
            n = np.maximum(np.bincount(doc, minlength=hi - lo), 1)
            out.append(np.bincount(doc, weights=self.weights[feature], minlength=hi - lo) / np.sqrt(n) + self.bias)
        return sigmoid(self.a * np.concatenate(out) + self.b) if out else np.zeros(0)


def fit_rows(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0, c: float = 1.0) -> tuple[np.ndarray, float]:
    """Feature weights and bias of the NB-SVM. rows: each text's feature ids; y: 0 or 1."""
    counts = np.full((2, DIMS), alpha)
    for ids, label in zip(rows, y, strict=True):
        counts[int(label), ids] += 1
    p = counts / counts.sum(1, keepdims=True)
    ratio = np.log(p[1] / p[0])
    w = hinge_dual([(ids, ratio[ids] / np.sqrt(max(len(ids), 1))) for ids in rows], np.where(y == 1, 1.0, -1.0), DIMS, c)
    return w[:-1] * ratio, float(w[-1])


def fit(rows: list[np.ndarray], y: np.ndarray) -> QualityModel:
    """The model with calibrated scores, from out-of-fold margins of three folds."""
    if len(set(y.tolist())) < 2:
        p = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return QualityModel(np.zeros(DIMS, np.float32), 0.0, 1.0, float(np.log(p / (1 - p))))
    fold, margin = folds(len(rows)), np.zeros(len(rows))
    for k in range(3):
        inside = [i for i in range(len(rows)) if fold[i] != k]
        w, bias = fit_rows([rows[i] for i in inside], y[inside])
        for i in np.flatnonzero(fold == k):
            margin[i] = w[rows[i]].sum() / np.sqrt(max(len(rows[i]), 1)) + bias
    a, b = platt(margin, y)
    w, bias = fit_rows(rows, y)
    return QualityModel(w.astype(np.float32), bias, a, b)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = text_bytes(batch.column("text"))
        lists = []
        for lo, hi, d, o in pieces(data, offs):
            doc, feature = features(d, o)
            lists += np.split(feature.astype(np.int32), np.searchsorted(doc, np.arange(1, hi - lo)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("label").cast(pa.int32()), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "label", "features"])
    give_back()


def train_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> QualityModel:
    """Fits to at most rows labelled, not held-out documents; their feature ids are made on the executors."""
    sample = labelled_sample(docs, labels, "quality", rows).mapInArrow(_feature_rows, "doc_id long, label int, features array<int>").toArrow()
    found = sorted(zip(sample["doc_id"].to_pylist(), sample["label"].to_pylist(), (np.asarray(x.values, np.int64) for x in sample["features"].combine_chunks())), key=lambda r: (r[0], r[1], len(r[2])))
    model = fit([f for _, _, f in found], np.array([label for _, label, _ in found], float))
    del sample, found
    give_back()  # the driver's memory, for the steps that come after
    return model


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted (1 from the threshold on), with `_` behind where docs have such columns; map-only."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        found = pa.array(model.scores(texts), pa.float64())
        give_back()
        return found

    at, say = free_name(docs, "score"), free_name(docs, "predicted")
    return docs.withColumn(at, score("text")).withColumn(say, (F.col(at) >= threshold).cast("int"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every whole text."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = train_quality(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return score_quality(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
