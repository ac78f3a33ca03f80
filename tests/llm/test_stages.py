"""The pipeline stage by stage against brute force, and operators on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import collections
import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import brute_hits, prose

import corpus_pipeline
from lumenlog.llm import decontaminate, html_extract, media_chunks, mixing, near_dedup, quality, token_counts, toxicity, url_filter

CLASH = "score predicted removed_words copy copies key root salt _clean size n row".split()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents of two sources: good prose, shouted junk, toxic ones, copies, benchmark passages, nulls; with columns that clash."""
    rng, rows = np.random.default_rng(1), []
    items = [prose(900 + k, 14) for k in range(3)]
    for k in range(420):
        text = prose(k, int(rng.integers(20, 80)))
        kind = ("good", "junk", "toxic", "good", "good", "bench")[k % 6]
        if kind == "junk":
            text = text.upper().replace(" ", "!! ")
        elif kind == "toxic":
            text += " you stupid idiot, you worthless scum " + prose(5000 + k, 5)
        elif kind == "bench":
            text = " ".join([*text.split()[:10], items[k % 3], *text.split()[10:]])
        rows.append((k, text, kind))
    rows += [(1000 + k, rows[k][1], rows[k][2]) for k in (0, 3, 4, 6)] + [(2000, " ".join(["changed", *rows[0][1].split()[1:]]), "good"), (0, rows[0][1], "good")]
    rows += [(3000, None, "none"), (3001, "", "none"), (None, prose(7777, 40), "good"), (None, None, "none"), (3002, prose(3002, 6000), "good"), (3003, prose(3003, 60), None)]
    docs = spark.createDataFrame([(i, t, "en", None if i is None or i % 5 == 0 else f"s{i % 2}", len(t or ""), kind, *[f"{c}{n}" for c in CLASH]) for n, (i, t, kind) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, kind string, " + ", ".join(f"`{c}` string" for c in CLASH))
    path = str(tmp_path_factory.mktemp("corpus"))
    docs.repartition(4).write.parquet(f"{path}/documents.parquet")
    labelled = [(i, int(kind != "junk"), int(kind == "toxic")) for i, _, kind in rows[:420]] + [(None, 1, 0), (1, None, None)]
    spark.createDataFrame(labelled, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([*enumerate(items), (9, None), (None, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    by_row, columns, kept = {r.n: r for r in docs.collect()}, docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.settle(stage(spark, docs, corpus), name)
        kept[name] = docs.collect()
        assert docs.columns == (columns if name != "mixing" else [*columns, "copy_"])
        for r in kept[name]:
            assert all(r[c] == by_row[r.n][c] for c in (*CLASH, "doc_id", "source", "lang"))
        if name == "quality":
            kinds = collections.Counter(r.kind for r in kept[name])
            assert kinds["junk"] <= 1 and kinds["good"] > 215 and kinds["toxic"] + kinds["bench"] > 130
        elif name == "toxicity":
            kinds = collections.Counter(r.kind for r in kept[name])
            assert kinds["toxic"] <= 4 and kinds["good"] > 210 and kinds["bench"] > 66
        elif name == "near_dedup":
            group = {}
            for r in before.collect():
                words = re.findall(r"\w+", (r.text or "").lower())
                words = words[1:] if words[:1] == ["changed"] or len(words) > 100 else words[1:]
                group.setdefault(tuple(words), []).append(r)
            assert len(kept[name]) == len(group)
            least = {min((r.doc_id is None, r.doc_id or 0) for r in rows)[1] for rows in group.values()}
            assert {r.doc_id or 0 for r in kept[name]} == least
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
            hits = {r.n: brute_hits(r.text, items) for r in before.collect()}
            assert {r.n for r in kept[name]} == {n for n, (words, hit, _) in hits.items() if hit <= words / 2}
            for r in kept[name]:
                assert brute_hits(r.text, items)[1] == 0 and len(re.findall(r"\w+", r.text or "")) == hits[r.n][0] - hits[r.n][1]
                assert r.text == by_row[r.n].text or (hits[r.n][1] and r.n_chars == len(r.text))
        else:
            plan = {(r.doc_id, r.source, r["size"]): r.copies for r in mixing.mix_sources(before).collect()}
            assert len(kept[name]) == sum(plan.values())
    final = corpus_pipeline.run(spark, corpus)
    assert sorted((r.n, r.copy_, r.text or "") for r in final.collect()) == sorted((r.n, r.copy_, r.text or "") for r in kept["mixing"])


def test_pipeline_of_nothing(spark, corpus, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{name}.parquet").filter("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_accuracy(spark, corpus, kind):
    docs, labels = spark.read.parquet(f"{corpus}/documents.parquet"), spark.read.parquet(f"{corpus}/labels.parquet").dropDuplicates(["doc_id"])
    fit, score = (quality.train_quality, quality.score_quality) if kind == "quality" else (toxicity.train_toxicity, toxicity.score_toxicity)
    rows = score(docs, fit(docs, labels)).join(labels.select("doc_id", F.col(kind).alias("told")), "doc_id").filter("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 AND told IS NOT NULL").collect()
    assert len(rows) > 60
    right = [r.predicted_ == r.told for r in rows]
    found = [r.predicted_ for r in rows if r.told == (kind == "toxic")]
    assert np.mean(right) > 0.95 and abs(np.mean(found) - (kind == "toxic")) < 0.15
    assert all(r.score.startswith("score") for r in rows)  # the table's own column


def test_decontamination_in_blocks_and_of_joined_windows(spark):
    items = [prose(10 + k, 12) for k in range(6)]
    w = items[0].split()
    texts = [" ".join([*w[:5], items[1], *w[5:], prose(1, 60)]), " ".join([prose(2, 30), items[5], "x", items[2]]), prose(3, 20), None, items[3], items[1] + " " + prose(4, 20)]
    docs = spark.createDataFrame([(k, t, "c", 5) for k, t in enumerate(texts)], "doc_id long, text string, _clean string, removed_words long")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = sorted((k, *brute_hits(t, list(enumerate(items)))) for k, t in enumerate(texts))
    for block_words in (10**6, 30, 5):
        rows = decontaminate.count_hits(docs, bench, block_words=block_words).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in rows) == want
        clean = decontaminate.decontaminate(docs, bench, block_words=block_words).collect()
        kept = {r.doc_id: r for r in clean}
        assert sorted(kept) == [0, 1, 2, 3, 5] and kept[0].text == prose(1, 60) and kept[0].removed_words_ == 24  # the outer window came together
        assert all(brute_hits(r.text, list(enumerate(items)))[1] == 0 and r.removed_words == 5 and r._clean == "c" for r in clean)


def test_token_counts_by_document(spark, tmp_path):
    texts = [prose(1, 30), None, "", "x" * 3000, "<|endoftext|>", prose(2, 5), prose(2, 5)]
    spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, file long, block long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    encode = token_counts.tokenizer(token_counts.TOKENIZER).encode_ordinary
    rows = token_counts.op4_token_counts(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.n_tokens, r.closed) for r in rows} == {(k, len(encode(t or "")), True) for k, t in enumerate(texts)} and len(rows) == len(texts)


def test_raw_token_files(spark, tmp_path):
    rng, want = np.random.default_rng(0), {}
    for name, sizes in (("a", [3, 0, 700, 1, 0, 40]), ("b", []), ("c", [5000])):
        ids = [np.append(rng.integers(0, 50, n), 50256) for n in sizes] + [rng.integers(0, 50, 7)]
        (tmp_path / f"{name}.bin").write_bytes(np.concatenate(ids).astype("<u2").tobytes())
        want |= {(name, k): (n, True) for k, n in enumerate(sizes)} | {(name, len(sizes)): (7, False)}
    blocks = token_counts.read_token_files(spark, str(tmp_path), block_bytes=64)
    rows = token_counts.count_documents(blocks, range_blocks=3).collect()
    assert {(r.file[-5], r.ordinal): (r.n_tokens, r.closed) for r in rows} == want and len(rows) == len(want)


def test_html_pages(spark):
    body = "".join(f"<p>{prose(k, 12)}</p>" for k in range(3))
    frame = "<html><head><title>T</title></head><body><nav><a>Home</a></nav>{}<footer>all of us</footer></body></html>"
    rows = [frame.format(f"<article>{body}</article>"), None, "", "<p>", frame.format(f"<div id=c>{body}</div><div class=x><p>short one</p></div>"), frame.format(f"<article>{body}<div class='share price'><p>up it went</p></div><div class='ad-slot'>buy now</div></article>"),
            frame.format(f"<aside><article>teaser words here</article></aside><article>{body}</article><section class=comments><article class=comment>{prose(9, 30)}</article></section>"), frame.format(f"<nav><a>open<article>{body}</article>"), frame.format(f"<article>{body * 4000}</article>")]
    pages = spark.createDataFrame([(k, h, "mine") for k, h in enumerate([*rows, rows[0], rows[0]])], "page_id long, html string, text string").repartition(3)
    found = {r.page_id: r for r in html_extract.extract_pages(pages, html_extract.labelled_weights(pages)).collect()}
    text = "\n\n".join(prose(k, 12) for k in range(3))
    assert len(found) == len(rows) + 2 and all(r.text == "mine" for r in found.values())
    want = [text, "", "", "", text + "\n\nshort one", text + "\n\nup it went", text, text, "\n\n".join([text] * 4000), text, text]
    assert [found[k].text_ for k in range(len(want))] == want
    empty = pages.filter("false")
    assert html_extract.labelled_weights(empty) == {} and html_extract.extract_pages(empty, {}).count() == 0


def test_html_topics_layout_buttons_and_several_articles():
    frame = "<html><head><title>T</title></head><body><nav><a>Home</a></nav>{}<footer>all of us</footer></body></html>"
    weights = html_extract.learn_weights([frame.format(f"<div class=ad>buy it</div><article><h1>title</h1><p>{prose(1, 30)}</p></article>")] * 20)
    lead, end = f"<p>{prose(1, 20)}</p>", f"<p>{prose(2, 20)}</p>"
    text = [prose(1, 20), prose(2, 20)]
    read = lambda inner: html_extract.extract(frame.format(inner), weights).split("\n\n")
    for mark in ("section class='menu'", "div class='cookies box'", "div class=related", "div id=share"):
        name = mark.split()[0]
        assert read(f"<article>{lead}<{mark}>{prose(3, 15)} <a>x</a></{name}>{end}</article>") == [text[0], prose(3, 15) + " x", text[1]]
        assert read(f"<article>{lead}<{mark}><a>one two</a> <a>three</a> or</{name}>{end}</article>") == text
    for mark in ("div class='user-comment box'", "div class='ad box'", "ul class='reader-comments list'", "div class='row ad-slot'", "section class=comments"):
        assert read(f"<article>{lead}<{mark}>{prose(3, 40)}</{mark.split()[0]}>{end}</article>") == text
    assert read(f"<article>{lead}<div class='price box'>it went up</div>{end}</article>") == [text[0], "it went up", text[1]]
    assert read(f"<article>{lead}<p>see <button>this</button> here</p><button>Send</button>{end}</article>") == [text[0], "see this here", text[1]]
    promo = f"<div>{prose(5, 80)}</div>"
    assert read(f"<article>{lead}</article>{promo}<article>{end}</article>") == text
    assert read(f"<article>{lead}{end}</article><article><a>read this too</a></article><aside><article>{prose(6, 9)}</article></aside>") == text


def test_html_quotes_that_nothing_closes():
    body = f"<article><p>{prose(1, 20)}</p><p title='a > b'>{prose(2, 20)}</p></article>"
    stray = "<a title=\"x>y</a>" * 101 + "<i>z</i>" + "<p title='>'>"  # an odd number of quotes
    ends, page = {}, stray + body
    for k in range(len(page)):
        m = html_extract._REST.match(page, k)
        assert html_extract._tag_end(page, k, ends) == (m.end() if m else -1)
    assert html_extract.extract(stray.replace('"', "") + body, {}).endswith(prose(2, 20)) and " b'" not in html_extract.extract(page, {})


@pytest.mark.parametrize("piece", ["<a \"", "<a '\"", "<a \">", "<", "<!--", "<p ", "<script", "<div class=ad "])
def test_broken_markup_takes_linear_time(piece):
    import time

    start = time.time()
    html_extract.extract(piece * (2_000_000 // len(piece)), {})
    assert time.time() - start < 30


def test_html_region_against_brute_force():
    """Pages of plain blocks with plain weights: the best contiguous run of words and tags, by trying all."""
    rng = np.random.default_rng(0)
    for _ in range(60):
        seq = []
        for _ in range(int(rng.integers(1, 12))):
            seq += [(None, "div", False)] * int(rng.integers(0, 4)) + [(" ".join(["w"] * int(rng.integers(1, 5))), None, False)]
        score = [len(t.split()) if t else -1.5 for t, _, _ in seq]
        best = max(((sum(score[a:b]), -a, -b) for a in range(len(seq)) for b in range(a + 1, len(seq) + 1)), key=lambda x: (round(x[0], 9), x[1], x[2]))
        start, stop = html_extract._region(seq, {"div": -1.5}, False)
        assert sum(score[start:stop]) == pytest.approx(best[0])
    assert html.unescape("&amp;") == "&"


def test_urls_of_learned_words_nulls_and_clashes(spark):
    urls = ["http://quartz-lemur.example.net/en/recipes"] * 3 + ["http://quartzlemur.example.net/", None, "", "x", "http://casino-win.example.net/", "http://CasinoWin.example.net/a", "http://" + "q" * 300 + "freebets.example.net/", "https://a.b.example.org/es/", "http://com/de/", "ftp://notcom/de/"]
    pages = spark.createDataFrame([(k, u, "mine", "mine") for k, u in enumerate(urls)], "page_id long, url string, host string, verdict string").repartition(3)
    words = url_filter.url_words(pages)
    assert words == {"quartz": 3, "lemur": 3, "recipes": 3, "en": 3, "de": 2}
    assert url_filter.UrlModel(words=words).segment("quartzlemur") == ["quartz", "lemur"] and url_filter.UrlModel().segment("quartzlemur") != ["quartz", "lemur"]
    rows = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    assert [rows[k].verdict for k in range(len(urls))] == ["allow"] * 7 + ["block"] * 3 + ["block", "block", "allow"] and rows[4].host == rows[5].host == ""
    assert (rows[10].rule, rows[11].rule, rows[12].rule) == ("example.org/es/", "com/de/", None) and rows[10].log_odds is None
    assert url_filter.judge_urls(pages.filter("false")).count() == 0


def test_media_of_known_chunks_and_equal_texts(spark):
    rng = np.random.default_rng(2)
    long = "".join(chr(c) for c in rng.integers(33, 127, 200_000))
    texts = ["", None, "", "RIFF" + chr(12) * 4 + "WAVE" + "x" * 52, long, "y" + long, *["same"] * 200]
    docs = spark.createDataFrame([(k if k % 7 else None, t, "m", 1) for k, t in enumerate(texts)], "doc_id long, text string, media string, salt int").repartition(4)
    lists, chunks = media_chunks.store_texts(docs, b"")
    assert chunks.filter("part").count() < 2 * lists.filter("size(list) > 1").agg(F.max(F.size("list"))).first()[0]  # the long texts share chunks
    _, more = media_chunks.store_texts(docs.unionByName(spark.createDataFrame([(99, "new", "m", 1)], docs.schema)), b"", chunks)
    assert more.count() == 1
    rows = media_chunks.media_columns(docs).collect()
    assert len(rows) == len(texts) and sorted(r.n_bytes for r in rows) == sorted(len((t or "").encode()) for t in texts)
    assert len({(r.media_sha256, r.feature) for r in rows if r.n_bytes == 4}) == 1 and near_dedup is not None


def test_training_gives_the_drivers_memory_back(spark, corpus, monkeypatch):
    """Workers have their own modules, so only the driver's calls are seen here."""
    calls, docs, labels = [], spark.read.parquet(f"{corpus}/documents.parquet"), spark.read.parquet(f"{corpus}/labels.parquet")
    for module, train in ((quality, quality.train_quality), (toxicity, toxicity.train_toxicity)):
        monkeypatch.setattr(module, "give_back", lambda name=module.__name__: calls.append(name))
        train(docs, labels)
    assert calls == [quality.__name__, toxicity.__name__]
