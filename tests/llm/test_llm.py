"""The operators of lumenlog.llm against brute force, on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenlog.llm import chat_format, decontaminate, html_extract, learning, media_chunks, mixing, near_dedup, quality, token_counts, toxicity, url_filter

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega été größe".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[k]}{j % 7}" for j, k in enumerate(rng.integers(0, len(WORDS), n)))


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    half = " ".join([*words[:60], *prose(2, 60).split()])
    texts = [base, re.sub("[a-z]", lambda m: m[0].upper(), base), near, half, prose(3, 90), "", None, "", "one two", "one two", "!!!", prose(4, 4000), base]
    rows = [(k, t, "en", None if k % 3 == 0 else f"s{k % 3}", 1, "x", 7) for k, t in enumerate(texts)]
    rows += [(None, "lost id text", None, None, None, None, None), rows[-1]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, n int").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def test_mixing(docs, none):
    rows = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == docs.count()
    assert all(r.taken <= 2 * r["size"] and r.taken % max(r["size"], 1) == 0 for r in rows)
    for _, group in itertools.groupby(sorted(rows, key=lambda r: str(r.source)), key=lambda r: r.source):
        group = list(group)
        assert sum(r["size"] for r in group) == group[0].source_size
        assert 0 <= group[0].target - sum(r.taken for r in group) <= max(r["size"] for r in group)
    assert mixing.mix_sources(none).count() == 0
    assert mixing.mix_rows(docs.filter("doc_id < 5")).count() == sum(r.copies for r in mixing.mix_sources(docs.filter("doc_id < 5")).collect())


def test_mix_rows_of_repeated_and_null_ids(spark):
    rows = [(i, f"{t} {w} word", "s", k) for k, (i, t, w) in enumerate(itertools.product((None, 1, 2), "abc", ("x", "y", "z")))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").repartition(3)
    plan = mixing.mix_sources(frame).collect()
    assert {r.copies for r in plan if r.doc_id is None} | {r.copies for r in plan if r.doc_id == 1} == {1, 2}
    mixed = mixing.mix_rows(frame).collect()
    assert sum(len(r.text.split()) for r in mixed) == sum(r.taken for r in plan) and len({(r.n, r.copy) for r in mixed}) == len(mixed)
    for i in (None, 1, 2):
        assert sum(r.doc_id == i for r in mixed) == sum(r.copies for r in plan if r.doc_id == i)
    few = mixing.mix_rows(frame, share=0.5).collect()
    assert 0 < len(few) == sum(r.copies for r in mixing.mix_sources(frame, share=0.5).collect()) < len(rows)


def test_water_level_and_knapsack(spark):
    sources = spark.createDataFrame([(10, 3.0), (100, 1.0), (100, 2.0)], "size long, weight double")
    level = float(mixing.water_level(sources, 315))
    targets = [min(2 * n, level * w) for n, w in ((10, 3), (100, 1), (100, 2))]
    assert mixing.water_level(sources, 421) is None and mixing.water_level(sources.filter("false"), 0) is None
    assert targets[0] == 20 and sum(targets) == pytest.approx(315) and targets[2] == pytest.approx(2 * targets[1], rel=0.05)
    rng = np.random.default_rng(0)
    for _ in range(40):
        lengths = sorted(set(rng.integers(1, 30, 4).tolist()))
        counts = rng.integers(1, 4, len(lengths)).tolist()
        budget = int(rng.integers(0, sum(a * b for a, b in zip(lengths, counts))))
        best = max(s for t in itertools.product(*(range(c + 1) for c in counts)) if (s := sum(a * b for a, b in zip(lengths, t))) <= budget)
        take = mixing.fit_budget(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts)) and sum(a * b for a, b in zip(lengths, take)) == best


def test_url_filter(spark):
    urls = ["http://a.example.ORG/es/x", "https://example.org/en/1?x", "http://x.org", "http://x.com/de/1#a", "http://free-bets.example.net/en/", "http://cheappills.example.net", "no url", None, "http://m.news.example.net/en/4"]
    rows = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [(rows[k].rule, rows[k].verdict) for k in range(9)] == [("example.org/es/", "block"), ("example.org/en/1", "block"), (None, "allow"), ("com/de/", "block"), (None, "block"), (None, "block"), (None, "allow"), (None, "allow"), (None, "allow")]
    assert (rows[0].host, rows[3].path, rows[7].host) == ("a.example.org", "/de/1", "")
    model = url_filter.UrlModel()
    assert model.segment("freecasinobets") == ["free", "casino", "bets"] and model.segment("") == []


def test_url_segments_of_any_length():
    model = url_filter.UrlModel()
    words, unknown = sorted(model.unigram), math.log(10 / model.total)

    def brute(name):
        best = [(0.0, [])]
        for end in range(1, len(name) + 1):
            options = []
            for begin in range(end):
                piece = name[begin:end]
                options.append((best[begin][0] + model.unigram.get(piece, unknown - len(piece) * math.log(10)), [*best[begin][1], piece]))
            best.append(max(options, key=lambda x: x[0]))
        return best[-1][1]

    rng = np.random.default_rng(2)
    for _ in range(150):
        parts = [words[rng.integers(len(words))] if rng.random() < 0.6 else "".join(rng.choice(list("qzxnews"), rng.integers(1, 40))) for _ in range(rng.integers(1, 7))]
        assert model.segment("".join(parts)) == brute("".join(parts))
    assert model.log_odds("q" * 70 + "casinobets", "") == pytest.approx(model.log_odds("casino.bets", "")) and model.log_odds("q" * 70 + "casinobets", "") > 0
    assert len(model.segment("casinoq" * 20_000)) == 40_000


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_classifiers(spark, docs, none, kind):
    rng = np.random.default_rng(5)
    texts = []
    for k in range(300):
        good = k % 3 > 0
        text = prose(100 + k, int(rng.integers(5, 60)))
        texts.append((k, text if good else text.upper() + "!!" if kind == "quality" else text + " you stupid idiot " + prose(k, 5), int(good if kind == "quality" else not good)))
    frame = spark.createDataFrame(texts, "doc_id long, text string, label int")
    labels = frame.select("doc_id", F.col("label").alias(kind), F.lit("x").alias("text"))
    fit, score = (quality.train_quality, quality.score_quality) if kind == "quality" else (toxicity.train_toxicity, toxicity.score_toxicity)
    model = fit(frame, labels)
    rows = score(frame, model).collect()
    assert np.mean([r.predicted == r.label for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    assert score(docs, model).count() == docs.count() and score(none, model).count() == 0
    assert fit(frame, labels.filter("false")) is not None


def test_token_counts(spark, docs, none):
    found = token_counts.settle(token_counts.write_token_files(docs, block_bytes=64), "t")
    counts = {(r.file, r.ordinal): r.n_tokens for r in token_counts.count_documents(found.filter("block >= 0")).collect()}
    encode = token_counts.tokenizer(token_counts.TOKENIZER).encode_ordinary
    want = sorted(len(encode(r.text or "")) for r in docs.collect())
    assert sorted(counts.values()) == want
    raw = [5, 9, 9, 1, 2, 3, 4, 9, 7]
    data = np.array(raw, "<u2").tobytes()
    blocks = spark.createDataFrame([("f", k, bytearray(data[2 * k * 2 : 2 * (k + 1) * 2])) for k in range(5)], "file string, block long, tokens binary")
    assert sorted((r.ordinal, r.n_tokens, r.closed) for r in token_counts.count_documents(blocks, 9).collect()) == [(0, 1, True), (1, 0, True), (2, 4, True), (3, 1, False)]
    assert token_counts.count_documents(blocks.filter("false"), 9).count() == 0


def test_media(docs, none):
    rows = media_chunks.media_columns(docs).collect()
    texts = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.collect())
    assert len(rows) == len(texts)
    for r, (i, text) in zip(sorted(rows, key=lambda r: r.doc_id if r.doc_id is not None else -1), texts):
        raw = text.encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(media_chunks.to_media(payload)).hexdigest() and r.media_bytes == len(payload) + 44
    assert media_chunks.media_columns(none).count() == 0
    data = np.random.default_rng(0).integers(0, 256, 400_000).astype(np.uint8).tobytes()
    a, b = media_chunks.cuts(data), media_chunks.cuts(b"x" * 100 + data)
    assert a[-1] == len(data) and max(np.diff([0, *a])) <= media_chunks.MOST and len({x + 100 for x in a} & set(b)) > len(a) // 2


def brute_hits(text, items, window=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, names = find(text), set(), set()
    for name, item in items:
        it = find(item)
        n = min(window, len(it))
        for k in range(len(it) - n + 1 if n else 0):
            for at in range(len(words) - n + 1):
                if words[at : at + n] == it[k : k + n]:
                    hit |= set(range(at, at + n))
                    names.add(str(name))
    return len(words), len(hit), sorted(names)


def test_decontaminate(spark, docs, none):
    base = prose(1, 120).split()
    items = [(1, " ".join(base[10:40])), (2, "One, Two"), (3, ""), (4, None), (5, " ".join(base[30:45])), (6, prose(9, 12)), (1, prose(3, 90)[:200])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.count_hits(docs, bench).collect()
    want = sorted(str((r.doc_id, *brute_hits(r.text, items))) for r in docs.collect())
    assert sorted(str((r.doc_id, r.n_words, r.n_hit, list(r["items"]))) for r in rows) == want
    assert {r.n_hit for r in decontaminate.count_hits(docs, bench.filter("false")).collect()} == {0} and decontaminate.count_hits(none, bench).count() == 0
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.filter("doc_id = 3").first().text and decontaminate.count_hits(clean, bench).agg(F.max("n_hit")).first()[0] == 0
    assert clean.filter("doc_id in (8, 9)").count() == 0  # all of it is an item
    few = decontaminate.build_matchers([t or "" for _, t in items], block_words=20)
    assert len(few) > 1


def test_near_duplicates(docs, none):
    rows = near_dedup.near_duplicates(docs).collect()
    group = {r.doc_id: r.class_id for r in rows}
    assert [group[k] for k in (0, 1, 2, 12)] == [0] * 4 and group[3] == 3 and group[5] == group[6] == group[7] == 5 and group[8] == group[9] == 8 and group[10] == 10
    kept = near_dedup.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [0, 3, 4, 5, 8, 10, 11] and len(kept) == 8
    assert near_dedup.near_duplicates(none).count() == 0
    links = {r.doc_id: r.n_verified for r in rows}
    assert links[0] == links[1] == links[2] == links[12] == 1 and links[3] == links[5] == 0


def test_keep_one_of_repeated_and_null_ids(spark):
    a, b, c = prose(21, 80), prose(22, 80), prose(23, 80)
    near = lambda t: " ".join(["changed", *t.split()[1:]])
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (1, a), (None, c), (None, c), (None, near(c)), (None, b), (5, prose(24, 80)), (None, ""), (None, None)]
    kept = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    texts = sorted((r.doc_id or 0, r.text or "") for r in kept)
    assert texts[0] == (0, "") and texts[1] in ((0, c), (0, near(c))) and texts[2:] == sorted([(1, a), (1, b), (5, prose(24, 80))])


def test_near_duplicates_brute(spark):
    rng, texts = np.random.default_rng(7), []
    for g in range(12):
        base = prose(50 + g, 80).split()
        for _ in range(5):
            words = list(base)
            for at in rng.integers(0, 80, rng.integers(0, 4)):
                words[at] = f"edit{rng.integers(1000)}"
            texts.append(" ".join(words))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    common = near_dedup.common_shingles(frame)
    packed = []
    for t in texts:
        keys, times, *_ = near_dedup.shingles(*near_dedup.text_bytes(pa.array([t])))
        w = near_dedup.weights(keys, times, common)
        packed.append((keys >> np.uint64(32)).astype(np.uint32).tobytes() + w.astype(np.float16).tobytes())
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if near_dedup.similarity(packed[i], packed[j]) >= 0.8:
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    assert [r.class_id for r in near_dedup.near_duplicates(frame).orderBy("doc_id").collect()] == root


def test_html():
    weights = html_extract.learn_weights(["<html><body><nav><a>x</a><a>y</a></nav><div class=ad>z z</div><article><h1>t</h1><p>a b c d e f</p></article><footer>f</footer></body></html>"])
    page = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a>Home</a></ul></nav><div class='ad'>buy this now it is good and cheap</div><article><h1>Big &amp; news</h1><p>First  line<br>goes\non.<p>Second <b>one</b>.<div id='comments'>nice post friend</div></article><footer>&copy; me and all of us here</footer>"
    assert html_extract.extract(page, weights) == "Big & news\n\nFirst line goes on.\n\nSecond one."
    assert html_extract.extract("", weights) == "" and html_extract.extract("<p>", weights) == "" and html_extract.extract("just words here", weights) == "just words here"


@pytest.mark.parametrize("element", ["article", "div"])
def test_html_keeps_the_ends_of_an_article(element):
    frame = "<html><head><title>T</title></head><body><nav><ul><li><a>Home</a></li><li><a>News</a></li></ul></nav><div class=ad>buy this</div>{}<footer>all of us</footer></body></html>"
    body = "".join(f"<p>{prose(k, 12)}</p>" for k in (1, 2))
    weights = html_extract.learn_weights([frame.format(f"<article><h1>title</h1>{body}</article>")] * 20)
    assert min(weights[t] for t in ("a", "li", "ul", "div")) < -2
    share = "<div class=share>" + "<a>Send</a>" * 4 + "</div>"
    items = "<ul><li>two eggs</li><li>flour</li><li>a cup of milk</li></ul>"
    between = (share, f"<aside>{prose(3, 60)}</aside>", f"<form>{prose(4, 60)}</form>", "<!-- x --><script>var a = 1;</script>" * 3)
    head = "<h1>eight words are enough for one good headline</h1>"
    read = lambda content: html_extract.extract(frame.format(f"<{element}>{content}</{element}>"), weights).split("\n\n")
    text = ["eight words are enough for one good headline", prose(1, 12), prose(2, 12)]
    assert read(head + body) == text
    for x in between:
        assert read(head + x + body) == text
    listed = ["two eggs", "flour", "a cup of milk"]
    assert read(items + head + body) == [*listed, *text] and read(head + body + items) == [*text, *listed]
    links = "<ul>" + "<li><a>see</a></li>" * 20 + "</ul>"
    assert read(head + links + body)[0] == text[0]
    assert (read(head + body + links) == [*text, *["see"] * 20]) == (element == "article")


def test_chat(spark):
    rows = [(1, 0, "user", r"a \ b [INST] <|im_end|> \[INST]"), (1, 1, "assistant", "x</s>"), (2, 0, "assistant", None), (3, 1, None, "t"), (3, 0, "user", ""), (None, 0, "user", "n"), (4, 0, "user", "u"), (4, 0, "user", "u")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, segments int")
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(turns)).collect()}
    assert [tuple(t) for t in out[1].turns] == [("user", rows[0][3]), ("assistant", "x</s>")] and out[1].loss_text == "x</s>" and out[1].valid
    assert not out[2].valid and [tuple(t) for t in out[3].turns] == [("user", ""), ("", "t")] and len(out[4].turns) == 2 and not out[4].valid
    assert out[1].formatted.count("[INST]") == 0 and out[1].formatted.count("<|im_end|>") == 2
    assert chat_format.format_chats(turns.filter("false")).count() == 0


def test_labelled_sample_is_bounded(spark, docs, none):
    hot = docs.unionByName(spark.range(300).selectExpr("1L AS doc_id", "concat('copy ', id) AS text", "'en' AS lang", "'s' AS source", "1 AS n_chars", "'x' AS key", "7 AS n"))
    labels = spark.createDataFrame([(k, k % 2) for k in (0, 1, 1, 2, 3, 4, 6)] + [(None, 1), (5, None)], "doc_id long, quality int")
    rows = learning.labelled_sample(hot, labels, "quality").collect()
    wanted = {k for k in (0, 1, 2, 3, 4, 6) if zlib.crc32(str(k).encode()) % 4 != 2}
    assert sorted(r.doc_id for r in rows) == sorted(wanted) and all(r.label == r.doc_id % 2 for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, learning.labelled_sample(hot.repartition(5), labels, "quality").collect()))
    assert len(learning.labelled_sample(hot, labels, "quality", rows=2).collect()) <= 2
    assert learning.labelled_sample(none, labels, "quality").count() == 0


@pytest.mark.parametrize("role", ["assis\ntant", "a\\", "\\n", "\n\n\\", "\\\n", "<|im_end|>\n\\n", "n", "assistant"])
def test_roles_that_hold_the_separator(spark, role):
    turns = spark.createDataFrame([(1, 0, role, "tant\nyo"), (1, 1, "user", "\\n")], "conv_id long, turn long, role string, text string")
    formatted = chat_format.format_chats(turns)
    row = chat_format.read_back(formatted).first()
    assert [(t.role, t.text) for t in row.turns] == [(role, "tant\nyo"), ("user", "\\n")]
