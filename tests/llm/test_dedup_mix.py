"""Near-dedup against independent sets of words, and the mix's balance, many sources, clashing columns and frequent keys."""

import collections
import itertools
import math
import re

import numpy as np
from pyspark.sql import functions as F

from lumenlog.llm import mixing, near_dedup


def prose(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in rng.integers(0, vocabulary, n))


def weighted(texts):
    """Each text's shingles and their weights, by the docstring's formula alone."""
    counts = []
    for t in texts:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        runs = [tuple(words[k : k + 5]) for k in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] * bool(words)
        counts.append(collections.Counter(runs))
    total = sum(bool(c) for c in counts)
    share = collections.Counter(s for c in counts for s in c)
    return [{s: (1 + math.log(tf)) * (1 + math.log(1 / max(share[s] / total, 1 / 16)) / 4) for s, tf in c.items()} for c in counts]


def alike(a, b):
    every = a.keys() | b.keys()
    return sum(min(a.get(s, 0), b.get(s, 0)) for s in every) / max(sum(max(a.get(s, 0), b.get(s, 0)) for s in every), 1e-9)


def test_classes_against_sets_of_words(spark):
    rng, texts, passage = np.random.default_rng(3), [], prose(999, 30)
    for g in range(30):
        base = prose(g, 90).split()
        for k in range(8):
            words = list(base)
            for at in rng.integers(0, 90, rng.integers(0, 5)):
                words[at] = f"edit{rng.integers(10**6)}"
            texts.append(" ".join(words) + (" " + passage if g % 2 else ""))
    texts += [prose(77, 3), prose(77, 3).upper(), prose(78, 4), "", None]
    vectors, sims = weighted(texts), {}
    for i, j in itertools.combinations(range(len(texts)), 2):
        if vectors[i] and vectors[j] and vectors[i].keys() & vectors[j].keys():
            sims[i, j] = alike(vectors[i], vectors[j])
    sims[len(texts) - 2, len(texts) - 1] = 1.0  # null and the empty text

    def components(least):
        root = list(range(len(texts)))
        for (i, j), sim in sims.items():
            if sim >= least:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
        return root

    found = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()}
    sure = [pair for pair, sim in sims.items() if sim >= 0.802]
    assert len(sure) > 150 and all(found[i].class_id == found[j].class_id for i, j in sure)  # recall 1
    loose = components(0.798)
    assert all(loose[k] == loose[found[k].class_id] for k in range(len(texts)))  # nothing else is joined
    assert len({r.class_key for r in found.values()}) == len({r.class_id for r in found.values()})


def test_exact_shares_of_common_shingles(spark):
    texts = [prose(k, 40) + (" the same five words here" if k % 3 == 0 else "") for k in range(60)]
    keys, idf = near_dedup.common_shingles(spark.createDataFrame([(t,) for t in texts], "text string"))
    share = collections.Counter(s for v in weighted(texts) for s in v)
    want = sorted(round(1 + math.log(60 / n) / 4, 9) for n in share.values() if n > 60 / 16)
    assert sorted(np.round(idf, 9).tolist()) == want and len(want) >= 1


def test_classes_of_ids_that_repeat(spark):
    a, b = prose(1, 60), prose(2, 60)
    rows = near_dedup.near_duplicates(spark.createDataFrame([(7, a), (7, b), (8, b)], "doc_id long, text string")).collect()
    by_class = collections.Counter(r.class_key for r in rows)
    assert sorted(by_class.values()) == [1, 2] and all(r.class_id == 7 for r in rows) and {r.class_rows for r in rows} == {1, 2}


def test_hub_and_chain_components(spark):
    star = [(b"h", f"s{k}".encode()) for k in range(300)]
    chain = [(f"c{k:03d}".encode(), f"c{k + 1:03d}".encode()) for k in range(40)]
    pairs = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in star + chain], "key binary, leader binary")
    roots = {bytes(r.key): bytes(r.root) for r in near_dedup.components(pairs).collect()}
    assert {roots[b] for _, b in star} == {b"h"} and {roots[b] for _, b in chain} == {b"c000"} and len(roots) == 342


def test_keep_one_of_clashing_columns(spark):
    a = prose(1, 60)
    docs = spark.createDataFrame([(1, a, "k1", 1, 1), (2, a, "k2", 2, 2), (2, prose(3, 50), "k3", 3, 3)], "doc_id long, text string, key string, _key long, _kept_id long")
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.key for r in kept.collect()) == ["k1", "k3"]


def sized(spark, rows, columns="doc_id long, source string, text string"):
    return spark.createDataFrame(rows, columns).repartition(3)


def test_a_small_budget_is_spent_in_proportion(spark):
    docs = sized(spark, [(n, "s", " ".join(["w"] * n)) for n in range(1, 121)])
    rows = mixing.mix_sources(docs, share=0.45).collect()
    taken = [r for r in rows if r.copies]
    assert abs(sum(r.taken for r in rows) - rows[0].target) <= 1
    short, long = (sum(r.taken for r in rows if low < r["size"] <= high) / sum(r["size"] for r in rows if low < r["size"] <= high) for low, high in ((20, 70), (70, 120)))
    assert len(taken) > 30 and 0.25 < short < 0.65 and 0.25 < long < 0.65


def test_targets_of_many_sources(spark):
    rng = np.random.default_rng(4)
    names = [f"s{k:03d}" for k in range(60)] + [None, "z\ue000", "z\U0001f600"]
    rows = [(k * 10 + j, s, " ".join(["w"] * int(rng.integers(1, 200 if k % 7 else 2000)))) for k, s in enumerate(names) for j in range(4)]
    found = {r.source: r for r in mixing.mix_sources(sized(spark, rows)).collect()}
    order = sorted((s for s in names if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    size = {s: found[s].source_size for s in names}
    left, free, target = 1.5 * sum(size.values()), set(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        if not (over := {s for s in free if unit * weight[s] > 2 * size[s]}):
            target |= {s: unit * weight[s] for s in free}
            break
        target |= {s: 2.0 * size[s] for s in over}
        left, free = left - sum(2 * size[s] for s in over), free - over
    assert all(abs(found[s].target - target[s]) < 1e-6 for s in names)


def test_mix_of_nulls_and_empty_texts(spark):
    rows = [(None, "s", None)] * 700 + [(k, "s", "") for k in range(700)] + [(k, None, "a b") for k in range(1100)] + [(None, "s", "c d e")] * 5
    found = mixing.mix_sources(sized(spark, rows)).collect()
    assert len(found) == len(rows) and all(r.taken == 0 for r in found if not r["size"])
    for source in ("s", None):
        mine = [r for r in found if r.source == source]
        assert 0 <= mine[0].target - sum(r.taken for r in mine) < 3


def test_mix_rows_of_clashing_columns(spark):
    names = "copy copies taken_id taken_source taken_size more row size u n".split()
    docs = sized(spark, [(k, "s", "a b c", *[f"{c}{k}" for c in names]) for k in range(6)], "doc_id long, source string, text string, " + ", ".join(f"{c} string" for c in names))
    mixed = mixing.mix_rows(docs)
    assert mixed.columns == [*docs.columns, "copy_"]
    assert all(getattr(r, c) == f"{c}{r.doc_id}" for r in mixed.collect() for c in names) and mixed.agg(F.sum("copy_")).first()[0] >= 3
    assert mixing.mix_rows(docs.filter("false")).count() == 0


def test_independent_edits(spark):
    """Texts of 200 words of which so many per cent were exchanged: every pair whose sets of five words reach 0.802 is one class, and none below 0.798."""
    rng, rows, pairs = np.random.default_rng(1), [], []
    shingled = lambda t: {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
    for percent in (1, 2, 3, 5):
        for _ in range(40):
            a = [f"w{k}" for k in rng.integers(0, 5000, 200)]
            b = list(a)
            for k in rng.choice(200, 2 * percent, replace=False):
                b[k] = f"w{rng.integers(0, 5000)}"
            one, other = shingled(a), shingled(b)
            pairs.append((len(rows), len(rows) + 1, len(one & other) / len(one | other)))
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    found = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all((found[a] == found[b]) == (j >= 0.8) for a, b, j in pairs if abs(j - 0.8) > 0.002) and sum(j > 0.802 for *_, j in pairs) > 70


def test_every_shingle_has_its_own_share(spark):
    """op7's weights (rare=0): the idf of each shingle follows its own count of documents, however rare; classes are those of that similarity."""
    rng, texts = np.random.default_rng(7), []
    for g in range(12):
        base = prose(50 + g, 80).split()
        for _ in range(5):
            words = list(base)
            for at in rng.integers(0, 80, rng.integers(0, 4)):
                words[at] = f"edit{rng.integers(1000)}"
            texts.append(" ".join(words))
    texts += ["one two", "one two", "", None, "!!!"]
    counts = [collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] * bool(w)) for w in (re.findall(r"\w+", t or "") for t in texts)]
    total, share = sum(bool(c) for c in counts), collections.Counter(s for c in counts for s in c)
    exact = [{s: (1 + math.log(tf)) * (1 + math.log(total / share[s]) / 4) for s, tf in c.items()} for c in counts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in near_dedup.signed_by_all_shares(docs).collect():
        w = np.frombuffer(r.vector or b"", np.float16, offset=len(r.vector or b"") // 6 * 4)
        assert np.allclose(np.sort(w.astype(float)), sorted(exact[r.doc_id].values()), atol=0.003)

    def components(vectors):
        root = list(range(len(texts)))
        for i, j in itertools.combinations(range(len(texts)), 2):
            if vectors[i] and vectors[j] and alike(vectors[i], vectors[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
        return root[:-5]

    found = [r.class_id for r in near_dedup.near_duplicates(docs, rare=0).orderBy("doc_id").collect()]
    assert found[:-5] == components(exact) != components(weighted(texts)) and found[-5:-3] == [60, 60] and found[-3:-1] == [62, 62]


def test_near_copies_in_a_large_group(spark, tmp_path):
    """op7 over 150 near copies of a text in a corpus of 2,200: each pair whose sets of five words reach 0.802 is in one class, and nothing is joined that pairs of 0.798 or more don't."""
    rng, texts = np.random.default_rng(11), []
    for edits, copies in ((2, 150), (4, 50)):
        base = [f"b{edits}x{k}" for k in range(120)]
        texts.append(" ".join(base))
        for _ in range(copies):
            words = list(base)
            for at in rng.choice(np.arange(6, 114, 6), edits, replace=False):
                words[at] = f"edit{rng.integers(10**9)}"
            texts.append(" ".join(words))
    group = len(texts)
    texts += [prose(5000 + k, 12, 3000) for k in range(2000)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.class_id for r in near_dedup.op7_near_dedup(spark, str(tmp_path)).collect()}
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts[:group])]
    sims = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in itertools.combinations(range(group), 2)}
    sure = [p for p, sim in sims.items() if sim >= 0.802]
    assert len(sure) >= 150 and all(found[i] == found[j] for i, j in sure)
    loose = list(range(group))
    for (i, j), sim in sims.items():
        if sim >= 0.798:
            low, high = sorted((loose[i], loose[j]))
            loose = [low if r == high else r for r in loose]
    assert all(loose[k] == loose[found[k]] for k in range(group)) and all(found[k] == k for k in range(group, len(texts)))
