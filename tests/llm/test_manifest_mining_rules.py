"""Merkle manifest, hard negatives and quality rules against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from test_llm import prose

from lumenlog.llm import hard_negatives as H
from lumenlog.llm import manifest as M
from lumenlog.llm import quality_rules as R

sha = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, at string, tree string, hash string, salt string, n string"


def leaf_of(i, t, lang, s, n):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, s, lang, n, t)))


def tree(hashes):
    """Levels of a tree over hashes, the leaves first."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, at):
    for level in levels[:-1]:
        low = at // 3 * 3
        yield level[low:at], level[at + 1 : low + 3]
        at //= 3


def brute_manifest(rows):
    by = {}
    for i, t, lang, s, n in rows:
        changed = t.replace("\n", "") if t is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else t
        by.setdefault(s, []).append((i is not None, i or 0, leaf_of(i, t, lang, s, n), leaf_of(i, changed, lang, s, n), i))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(by[s])]) for s in order]
    top = tree([t[-1][0] for t in trees])
    out = []
    for no, s in enumerate(order):
        for at, (_, _, leaf, start, i) in enumerate(sorted(by[s])):
            folded, proof = start, ""
            for left, right in [*siblings(trees[no], at), *siblings(top, no)]:
                folded, proof = sha(*left, folded, *right), proof + "".join(left + right)
            out.append((i, leaf, trees[no][-1][0], top[-1][0], sha(proof), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def manifest_rows(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y", "z", "s", "n") for r in rows], DOCUMENTS)
    docs = docs.repartition(5)
    out = M.manifest(docs, M.tampered_text(docs))[0].drop("source")
    return sorted(map(tuple, out.collect()), key=repr)


def test_manifest_with_few_upper_nodes(spark, monkeypatch):
    monkeypatch.setattr(M, "UPPER", 4)
    test_manifest(spark)


def test_manifest(spark):
    rng = random.Random(4)
    rows = [(k, f"text {k}\nof ä line {k % 3}", "en", f"s{0 if k % 3 == 0 else k % 7}", k) for k in range(60)]
    rows += [(k, None, None, None, None) for k in (100, 101)] + [(None, "a\nb", "de", "s1", 3), (None, None, None, None, None), (7, "", "", "", 0), (7, "", "", "", 0), (7, "other", "en", "s0", 5)]
    rows += [(200, "alone\n\n", "fr", "Z", 7), (201, "öne", "fr", "é", 3), (202, "x" * 100_000 + "\n", "en", "s2", 9), (-5, "\n", "en", "s3", 1)]
    rng.shuffle(rows)
    found = manifest_rows(spark, rows)
    assert found == brute_manifest(rows)
    assert any(not r[-1] for r in found) and any(r[-1] for r in found)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10])
def test_manifest_of_one_source(spark, n):
    rows = [(k, f"t{k}\n", "en", "s", 2) for k in range(n)]
    assert manifest_rows(spark, rows) == brute_manifest(rows)


def test_manifest_of_nothing(spark):
    out, root = M.manifest(spark.createDataFrame([], DOCUMENTS))
    assert out.count() == 0 and root is None


def brute_negatives(rows, every=100):
    told = []
    for i, v, y in rows:
        if y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        told.append((i, (y + 1) % 10 if i is not None and i % 7 == 0 else y, [math.floor(256 * x) for x in v]))
    score = lambda a, b: min(max(sum(x * y for x, y in zip(a, b, strict=True)), -(1 << 63)), (1 << 63) - 1)
    best = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for k, (i, y, v) in enumerate(told):
        if i is None or i % every:
            continue
        others = [(score(v, w), j, z) for n, (j, z, w) in enumerate(told) if n != k and len(w) == len(v)]
        for p, pid, _ in sorted((o for o in others if o[2] == y), key=best)[:5]:
            hard = [o for o in others if o[2] != y and 30 * p <= 100 * o[0] <= 90 * p]
            out += [(i, pid, r, o[1], p, o[0]) for r, o in enumerate(sorted(hard, key=best)[:10], 1)]
    return sorted(out, key=repr)


def test_hard_negatives(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), [float(np.float32(x)) for x in rng.normal(0, 0.4, 6)], int(rng.integers(0, 3)) if k % 3 else 1) for k in range(420)]
    rows += [(300, rows[300][1], rows[300][2]), (5, rows[5][1], 2), (None, rows[8][1], 1), (None, rows[9][1], 0), (1000, None, 1), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1002, [float("nan")] * 6, 1), (1003, [float("inf")] * 6, 1), (1004, rows[4][1], None)]
    rows += [(600, [0.5, 0.25], 1), (601, [0.5, 0.2], 1), (603, [0.3, 0.1], 2), (700, [], 1), (701, [], 1), (702, [], 2), (800, [0.0] * 6, 1), (900, [2.0**80, 1.0, 0.0, 0.0, 0.0, 0.0], 2)]
    frame = spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows], "vec_id long, embedding array<double>, label int, anchor string, row long").repartition(6)
    expected = brute_negatives(rows)
    assert any(r[0] == 700 for r in expected) and sum(r[0] == 300 for r in expected) > 10
    for block in (4096, 3):
        assert sorted(map(tuple, H.mine(frame, block_anchors=block).collect()), key=repr) == expected


def test_hard_negatives_of_few(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert H.mine(spark.createDataFrame([], schema)).count() == 0
    assert H.mine(spark.createDataFrame([(1, [1.0], 1)], schema)).count() == 0  # no anchor
    assert H.mine(spark.createDataFrame([(100, [1.0], 1), (101, [1.0], 1)], schema)).count() == 0  # no negative


def test_negative_keys_sort():
    rng = random.Random(1)
    pairs = [(rng.randrange(3), rng.choice([-(1 << 63), -5, -1, 0, 1, 7, (1 << 63) - 1]), rng.randrange(2), rng.randrange(2), rng.choice([-9, 0, 4, (1 << 62)]), rng.randrange(4)) for _ in range(500)]
    keys = sorted(H.pack(*p) for p in pairs)
    assert keys == [H.pack(*p) for p in sorted(pairs, key=lambda p: (p[0], -p[1], *p[2:]))]
    assert all(H.unpack(H.pack(a, s, k, lost, i, r)) == (a, s, k, None if lost else i) for a, s, k, lost, i, r in pairs)


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, again = {}, set()
    for k in range(len(words) - 2):
        seen.setdefault(tuple(words[k : k + 3]), []).append(k)
    for at in seen.values():
        if len(at) > 1:
            again |= {k + j for k in at for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


TEXTS = [None, "", " \n\t ", "one", "a b c a b c", "a b c a b", "x x x x x x", "l1 a\nl1 a\n \n\nl1 a\r\nl1 a", "ä ö | # <b> *x* 日本 日本 日本 日本\x0b&", "    w\u0085w", "A b\nB a\nA b", "é" * 50 + " " + "b " * 30]


def test_rule_counts(spark):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice("a b c d\n e\n".split(" ")) for _ in range(rng.randrange(40))) for _ in range(200)] + [prose(1, 30_000), "long " * 200_000]
    docs = spark.createDataFrame([(k if k % 5 else None, t, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, n_words string, kept string").repartition(3)
    rows = R.judged(docs).collect()
    assert sorted([(r.doc_id, *(r[c] for c in R.COUNTS[:5])) for r in rows], key=repr) == sorted([(k if k % 5 else None, *brute_counts(t)) for k, t in enumerate(texts)], key=repr)
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert R.judged(docs.limit(0)).count() == 0
    same = R.with_quality(docs, R.rule_model(R.counted(docs)))
    assert same.columns == [*docs.columns, "quality"] and {round(r.posterior, 12) for r in rows} == {round(r.quality, 12) for r in same.collect()}


def test_estimated_accuracies():
    rng = np.random.default_rng(8)
    good = rng.random(60_000) < 0.85
    truth = [(0.02, 0.5), (0.05, 0.7), (0.01, 0.3), (0.1, 0.6), (0.03, 0.4)]
    votes = np.stack([np.where(rng.random(len(good)) < 0.2, 0, np.where(rng.random(len(good)) < np.where(good, a, b), -1, 1)) for a, b in truth], 1)
    distinct, n = np.unique(votes, axis=0, return_counts=True)
    model = R.estimate(distinct, n.astype(float), [f"r{k}" for k in range(5)])
    assert abs(model.prior - 0.85) < 0.03
    for (a, b), (x, y) in zip(truth, model.against.values(), strict=True):
        assert abs(a - x) < 0.02 and abs(b - y) < 0.08


def test_rules_keep_what_one_rule_is_against(spark):
    """Good prose stays though it lacks full stops; junk of several kinds goes; no label is read."""
    rows = [(k, prose(k, 120), 1) for k in range(300)]
    rows += [(1000 + k, prose(2000 + k, 120).replace(".", ""), 1) for k in range(6)]
    rows += [(2000 + k, prose(3000 + k, 120).upper().replace(" ", "!! "), 0) for k in range(40)]
    rows += [(3000 + k, " ".join(f"{w}{'#$%&'[j % 4] * 3}" for j, w in enumerate(prose(4000 + k, 120).split())), 0) for k in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    kept = {r.doc_id for r in R.judged(docs).filter("kept").select("doc_id").collect()}
    good = {i for i, _, y in rows if y}
    assert len(good & kept) >= 0.99 * len(good) and not kept - good
