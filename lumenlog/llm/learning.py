"""Small models in numpy, fitted on the driver to a bounded sample: linear hinge loss by dual coordinate descent, boosted
trees, Platt and isotonic calibration. All are deterministic."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import held_out, least_hashes

#: Labelled documents that a classifier is fitted to, at most.
SAMPLE_ROWS = 6000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, seed: int = 5) -> DataFrame:
    """Up to rows labelled documents (doc_id, text, label 0/1) that aren't held out, chosen by a seeded hash of the id.

    Null ids and labels are passed over; an id that is labelled repeatedly takes its largest label; of documents with the same id one
    counts, that of the least hash of its text, so the sample is bounded however often an id comes. The chosen ids, at most rows,
    are broadcast, and tasks keep one text of each, so the documents aren't shuffled.
    """
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col(label)).alias("label"))
    chosen = least_hashes(chosen, F.xxhash64(F.lit(seed), "doc_id"), rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id").agg(F.max("label").alias("label"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("at"))
    return one.select("doc_id", F.col("at.text").alias("text"), "label")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def hinge_dual(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dims: int, c: float = 1.0, epochs: int = 12, seed: int = 3) -> np.ndarray:
    """Weights (the last is the bias) of a linear model with hinge loss, by dual coordinate descent. rows: feature ids and values; y: -1 or 1."""
    w, alpha, rng = np.zeros(dims + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    norms = np.array([float(v @ v) + 1 for _, v in rows])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            ids, v = rows[i]
            gradient = y[i] * (w[ids] @ v + w[-1]) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), c)
            if step := (new - alpha[i]) * y[i]:
                alpha[i] = new
                w[ids] += step * v
                w[-1] += step
                moved = max(moved, abs(step))
        if moved < 1e-3 * c:
            break
    return w


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """a and b so that sigmoid(a * margin + b) fits y (0 or 1), by Newton's method with Platt's softened targets."""
    up, down = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x, theta = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ theta)
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - t))
        theta -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    return float(theta[0]), float(theta[1])


@dataclass
class Trees:
    """Gradient-boosted regression trees on the logistic loss; all trees have the same full depth, kept as arrays."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, inner = np.full(len(x), self.base), self.feature.shape[1]
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[0:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 5, ridge: float = 1.0) -> Trees:
    """Fits Trees by histograms over quantile bins, with Newton leaves. y: 0 or 1."""
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(k)]
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1) if n else np.zeros((0, k), np.int64)
    p0 = np.clip((y.sum() + 0.5) / (n + 1), 1e-3, 1 - 1e-3)
    base, inner = float(np.log(p0 / (1 - p0))), 2**depth - 1
    f_all, t_all, l_all, margin = [], [], [], np.full(n, base)
    for _ in range(trees if n else 0):
        p = sigmoid(margin)
        g, h = y - p, p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for here in range(inner):
            rows = np.flatnonzero(node == here)
            best = (1e-9, -1, 0)
            if len(rows) >= 2 * least:
                for j in range(k):
                    if not len(cuts[j]):
                        continue
                    size = len(cuts[j]) + 1
                    c = code[rows, j]
                    gl, hl, nl = (np.cumsum(np.bincount(c, weights=v, minlength=size))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                    gt, ht = g[rows].sum(), h[rows].sum()
                    gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                    gain[(nl < least) | (len(rows) - nl < least)] = 0
                    if gain.max() > best[0]:
                        best = (float(gain.max()), j, int(gain.argmax()))
            if best[1] >= 0:
                feature[here], threshold[here] = best[1], cuts[best[1]][best[2]]
            node[rows] = 2 * here + 1 + (x[rows, feature[here]] > threshold[here])
        leaf = rate * np.bincount(node - inner, weights=g, minlength=inner + 1) / (np.bincount(node - inner, weights=h, minlength=inner + 1) + ridge)
        margin += leaf[node - inner]
        f_all.append(feature)
        t_all.append(threshold)
        l_all.append(leaf)
    shape = (len(f_all), inner)
    return Trees(base, np.array(f_all, np.int64).reshape(shape), np.array(t_all, float).reshape(shape), np.array(l_all, float).reshape(len(f_all), inner + 1))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: scores and their calibrated probabilities, for linear interpolation between them. Ends are softened by a half count."""
    if not len(score):
        return np.array([0.0]), np.array([0.5])
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # sum of y, rows, lowest and highest score
    for s, v in zip(score[order], y[order], strict=True):
        if pools and pools[-1][3] == s:
            pools[-1][0] += v
            pools[-1][1] += 1
        else:
            pools.append([float(v), 1.0, float(s), float(s)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    xs, ps = [], []
    for total, n, low, high in pools:
        p = (total + 0.5 * (total == 0)) / (n + 0.5 * (total in (0, n)))
        for at in {low, high}:
            xs.append(at)
            ps.append(p)
    order = np.argsort(xs, kind="stable")
    return np.array(xs)[order], np.maximum.accumulate(np.array(ps)[order])


def folds(n: int, k: int = 3, seed: int = 9) -> np.ndarray:
    """A fold number for each of n rows."""
    return np.random.default_rng(seed).permutation(np.arange(n) % k)
