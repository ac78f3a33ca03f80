"""HTML extraction by the maximum-scoring subsequence: a page is a sequence of words and tags, words score positive and tags
negative, and one linear scan finds the contiguous region of the highest score. Tag weights come from labelled pages, which are
those that mark their article. Text of boilerplate elements, comments and scripts is never part of the result. Inside an article or main
element they score 0, so that they don't part what stands around them, and so they do on a page without either, but for the elements in
FRAME; elsewhere they score negative. Inline, list and table tags, and all tags inside an article or main element, take at most half of
the words that follow them; outside such an element they take at most all words of a link.

The region then grows to whole blocks: on both sides up to the next boilerplate element and, where an element marks the content, to its ends;
where none does, blocks of links alone at the ends are left out again. So a short paragraph behind many tags isn't lost.

Boilerplate elements are told by name or by the words of class, id and role: outside of content one word of HINTS is enough, inside an article
or main element every name in the attribute, but for those of layout, must begin or end with one of INNER, so that `ad-slot` and `ad box` go and
`share price` stays. What may as well be a topic (TOPICS: a menu of dishes, a recipe for cookies) goes only where links and controls hold at least
half of its words. A button inside a sentence of the content is text. An article in boilerplate, such as a teaser in a sidebar or a reader's
comment, is boilerplate. An element that is never closed ends where an article begins. Where the best region begins and ends in articles,
or they hold half of its words, the content is all articles of the page, in page order, but for those whose words are links for the most part.

Defined results: null html is the empty page; a page without words, or whose best region scores nothing, has the empty text;
unclosed, nested and cut-off markup is read as far as it goes; of equal regions the first counts; repeated rows are extracted each;
an empty table gives no rows; other columns are ignored; pages are read whole, in time linear in the page. Map-only: no shuffle.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import free_name, table, text_array

#: Pages that tag weights are learned from, at most.
SAMPLE_PAGES = 500
#: Elements that are never content, and words of attributes that mark others as such: anywhere, and outside an article or main element.
BOILERPLATE = frozenset("nav footer aside form menu dialog select button iframe noscript template object head title textarea svg canvas".split())
INNER = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent notice popup modal newsletter subscribe sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus replies reply respond related share sharing social footer masthead widget".split())
#: Those of INNER that may be a topic, and words of layout, which say nothing.
TOPICS = frozenset("menu cookie cookies related share sharing social navigation nav widget notice reply replies respond promo".split())
LAYOUT = frozenset("box block list item items wrapper wrap container inner outer section row col column grid panel area slot unit group left right top bottom center clearfix".split())
OUTER = frozenset("banner site-header login search legal copyright skip-link".split())
HINTS = re.compile(rf"(?:^|[\s_-])(?:{'|'.join(sorted(INNER | OUTER))}|side-bar)(?:$|[\s_-])", re.I)
#: Elements between which text is in different blocks.
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul title".split())
#: Boilerplate that parts the content of a page from the rest also where no element marks the content.
FRAME = frozenset("head header nav footer".split())
#: Inline, list and table elements, whose tags can't outweigh their words.
LIGHT = frozenset("a abbr b bdi bdo big caption cite code col colgroup data dd del dfn dl dt em font i img ins kbd li mark ol q s samp small span strike strong sub sup table tbody td tfoot th thead time tr tt u ul var".split())
#: Elements whose inside is no markup.
_RAW = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style", "title", "textarea", "noscript", "template")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OPEN = re.compile(r"<(?:!--|(/?)([a-z][^\s/>]*)|[!?/])", re.I)
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")  # to the end of a tag; never goes back
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_STOP = re.compile("[>\"']")
#: Elements whose words are links or controls.
CONTROLS = frozenset("a button label option select".split())

#: Score of a word in content, of one in boilerplate, and the bounds of a tag's.
WORD, OUTSIDE, LEAST, MOST = 1.0, -1.0, -3.0, -0.05
#: What tags score that no labelled page has.
UNSEEN = -0.5


def _tag_end(html: str, at: int, ends: dict[int, int]) -> int:
    """Where the tag ends whose attributes start here, -1 if quotes are open to the end of the page. ends keeps what is known for quotes, so that
    all tags of a page take linear time together, however many of its quotes nothing closes."""
    path, end = [], -1
    while m := _STOP.search(html, at):
        k = m.start()
        if m[0] == ">":
            end = k + 1
            break
        if k in ends:
            end = ends[k]
            break
        path.append(k)
        close = html.find(m[0], k + 1)
        if close < 0:
            break
        at = close + 1
    ends.update(dict.fromkeys(path, end))
    return end


def markup(html: str) -> list[tuple[str | None, str | None, str]]:
    """The page in order: (text, None, "") and (None, tag as "p", "/p" or "!", attributes). A raw element is its closing tag alone."""
    out, at, stray, ends = [], 0, False, {}
    while m := _OPEN.search(html, at):
        if m.start() > at:
            out.append((html[at : m.start()], None, ""))
        name = (m[2] or "").lower()
        if m[0] == "<!--":
            end = html.find("-->", m.end())
            at = end + 3 if end >= 0 else len(html)
            out.append((None, "!", ""))
            continue
        rest = None if stray else _REST.match(html, m.end())
        stray = rest is None
        end = _tag_end(html, m.end(), ends) if stray else rest.end()
        if end < 0:  # an open quote: the tag ends at the next >
            end = html.find(">", m.end()) + 1
        at = end or len(html)
        attributes = html[m.end() : at].rstrip(">")
        if not m[1] and name in _RAW:
            end = _RAW[name].search(html, at)
            at = end.end() if end else len(html)
            out.append((None, "/" + name, "raw"))
        else:
            out.append((None, (m[1] or "") + name if name else "!", attributes))
    if at < len(html):
        out.append((html[at:], None, ""))
    return out


def _marked(name: str, attributes: str, inside: bool, controls: Callable[[], bool]) -> bool:
    """Whether the attributes mark an element as boilerplate. controls tells whether links and controls hold at least half of its words."""
    if name in ("html", "body", "main") or not attributes:
        return False
    for found in _ATTRIBUTE.findall(attributes):
        value = "".join(found)
        if inside or name == "article":
            names = [re.split("[-_]", v) for v in value.lower().split()]
            words = [{w[0], w[-1]} & INNER for w in names if not LAYOUT.issuperset(w)]
            if words and all(words) and (any(w - TOPICS for w in words) or controls()):
                return True
        elif HINTS.search(value):
            return True
    return False


def items(html: str) -> list[tuple[str | None, str | None, bool]]:
    """The page in order: (text, None, inside boilerplate) and (None, tag as "p" or "/p", inside boilerplate)."""
    seq, open_at, closed = markup(html), {}, {}
    words, linked, level = [0], [0], 0  # so many words, and of these in links and controls, come before each item
    for k, (text, tag, attributes) in enumerate(seq):
        n = len(text.split()) if tag is None else 0
        words.append(words[-1] + n)
        linked.append(linked[-1] + (n if level > 0 else 0))
        if tag is None or attributes == "raw":
            continue
        if tag[0] != "/":
            open_at.setdefault(tag, []).append(k)
            level += tag in CONTROLS
        elif before := open_at.get(tag[1:]):
            closed[before.pop()] = k
            level -= tag[1:] in CONTROLS

    def controls(k: int) -> bool:
        end = closed.get(k)
        return end is not None and 2 * (linked[end] - linked[k]) >= words[end] - words[k]

    def in_sentence(k: int) -> bool:
        around = (k - 1, closed.get(k, len(seq)) + 1)
        return all(0 <= i < len(seq) and (seq[i][0] or "").strip() for i in around)

    out, shut, ends, depth, content = [], "", False, 0, 0
    for k, (text, tag, attributes) in enumerate(seq):
        if tag is None or tag == "!" or attributes == "raw":
            out.append((text, tag, depth > 0 or tag is not None))
            continue
        name = tag.lstrip("/")
        if depth and name in ("article", "main") and tag[0] != "/" and not ends:
            depth = 0  # the element around it is never closed
        if depth:
            if name == shut:
                depth += -1 if tag[0] == "/" else 1
            out.append((None, tag, True))
            continue
        if tag[0] != "/" and name not in _VOID and not attributes.endswith("/"):
            named = name in BOILERPLATE and not (name == "button" and content > 0 and in_sentence(k))
            if named or (name == "header" and content <= 0) or _marked(name, attributes, content > 0, lambda k=k: controls(k)):
                shut, ends, depth = name, k in closed, 1
        if name in ("article", "main") and not depth:
            content += -1 if tag[0] == "/" else 1
        out.append((None, tag, depth > 0))
    return out


def tag_counts(page: str) -> dict[str, list[int]]:
    """How often each tag, and as "" words, come inside and outside the page's articles; empty where it marks none."""
    seq, inside, counts = items(page), 0, {"": [0, 0]}
    if all(tag != "article" or out for _, tag, out in seq):
        return {}
    for text, tag, out in seq:
        if tag == "article" and not out:
            inside = 1
        counts.setdefault(tag or "", [0, 0])[inside] += 1 if text is None else len(text.split())
        if tag == "/article" and not out:
            inside = 0
    return counts


def weights_of(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Tag scores: the log-ratio of a tag's rate per word inside to outside, within LEAST and MOST. counts: outside and inside."""
    words = counts.get("", (0, 0))
    rate = lambda k, n: (n[k] + 0.5) / (words[k] + 1)
    return {t: min(MOST, max(LEAST, math.log(rate(1, n) / rate(0, n)))) for t, n in sorted(counts.items()) if t}


def learn_weights(pages: list[str]) -> dict[str, float]:
    """Tag scores from pages that mark their article."""
    total: dict[str, list[int]] = {}
    for page in pages:
        for tag, n in tag_counts(page).items():
            old = total.setdefault(tag, [0, 0])
            total[tag] = [old[0] + n[0], old[1] + n[1]]
    return weights_of(total)


def _region(seq: list, weights: dict[str, float], marked: bool) -> tuple[int, int]:
    """The first and the last + 1 item of the maximum-scoring subsequence."""
    best, start, stop, run, begin = 0.0, 0, 0, 0.0, 0
    content, frame, link, owed = 0, False, False, 0.0  # owed: what light tags cost that no words have paid yet
    for k, (text, tag, out) in enumerate(seq):
        n = len(text.split()) if tag is None else 0
        name = (tag or "").lstrip("/")
        if name in ("article", "main") and not out:
            content += -1 if tag[0] == "/" else 1
        frame = out and (frame or tag in FRAME)
        if out:
            if content <= 0 if marked else frame:
                run += OUTSIDE * n if tag is None else weights.get(tag, UNSEEN)
            if name in FRAME and tag[0] == "/":
                frame = False
        elif tag is None:
            if n:
                run += WORD * (n - min(owed, n if link and content <= 0 else n / 2))
                owed = 0.0
        elif name in LIGHT or content > 0:
            owed -= weights.get(tag, UNSEEN)
            link = tag == "a" if name == "a" else link
        else:
            run += weights.get(tag, UNSEEN)
        if run <= 0:
            run, begin = 0.0, k + 1
        elif run > best:
            best, start, stop = run, begin, k + 1
    return start, stop


def _grown(seq: list, start: int, stop: int) -> tuple[int, int]:
    """The region with what stands around it in the same content: up to boilerplate text or the ends of an article or main element. Where no such
    element holds the region, blocks of links alone at its ends are left out."""
    level, levels = 0, []
    for _, tag, out in seq:
        if tag in ("article", "main") and not out:
            level += 1
        levels.append(level)
        if tag in ("/article", "/main") and not out:
            level -= 1
    inside = max(levels[start:stop]) > 0
    stays = lambda k: levels[k] > 0 if inside else levels[k] == 0 and not seq[k][2]
    low, high = start, stop
    while low > 0 and stays(low - 1):
        low -= 1
    while high < len(seq) and stays(high):
        high += 1
    if not inside:
        linked, link = [], False
        for text, tag, out in seq[low:high]:
            link = tag == "a" if tag in ("a", "/a") else link
            linked.append(None if text is None or out or not text.strip() else link)
        plain = [k for k, x in enumerate(linked) if x is False]
        low, high = (min(start, low + plain[0]), max(stop, low + plain[-1] + 1)) if plain else (start, stop)
    return low, high


def _articles(seq: list, start: int, stop: int) -> list[tuple[int, int]]:
    """What is content if the region is: where both of its ends lie in articles, or these hold half of its words, all outermost articles of the page but
    those that are links for the most part, in page order; else the region."""
    found, level, begin = [], 0, 0
    words, link = [0, 0], False
    for k, (text, tag, out) in enumerate([*seq, *[(None, "/article", False)] * sum(tag == "article" for _, tag, _ in seq)]):
        if tag == "article" and not out:
            if level == 0:
                begin, words = k, [0, 0]
            level += 1
        if tag in ("a", "/a"):
            link = tag == "a"
        elif tag is None and not out:
            words[link] += len(text.split())
        if tag == "/article" and not out and level > 0:
            level -= 1
            if level == 0:
                found.append((begin, min(k + 1, len(seq)), words[0] > words[1], sum(words)))
    held = [x for x in found if x[0] < stop and start < x[1]]
    size = sum(len(text.split()) for text, tag, out in seq[start:stop] if tag is None and not out)
    ends = held and held[0][0] <= start and stop <= held[-1][1]
    if not ends and 2 * sum(x[3] for x in held) < max(size, 1):
        return [(start, stop)]
    return [x[:2] for x in found if x[2] or len(held) == 1 and x in held]


def extract(html: str, weights: dict[str, float]) -> str:
    """The text of the best region, and of other articles beside it: its blocks, white space folded, joined by an empty line."""
    seq = items(html)
    start, stop = _region(seq, weights, any(tag in ("article", "main") and not out for _, tag, out in seq))
    regions = _articles(seq, *_grown(seq, start, stop)) if start < stop else []
    blocks, part = [], []

    def flush() -> None:
        if joined := " ".join(entities.unescape("".join(part)).split()):
            blocks.append(joined)
        part.clear()

    for start, stop in regions:
        for text, tag, out in seq[start:stop]:
            if tag is None:
                if not out:
                    part.append(text)
            elif tag.lstrip("/") in BLOCKS:
                flush()
            elif tag == "br":
                part.append(" ")
        flush()
    return "\n\n".join(blocks)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: dict[str, list[int]] = {}
        for page in text_array(batch.column("html")).to_pylist():
            for tag, n in tag_counts(page).items():
                old = total.setdefault(tag, [0, 0])
                total[tag] = [old[0] + n[0], old[1] + n[1]]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([n[0] for n in total.values()], pa.int64()), pa.array([n[1] for n in total.values()], pa.int64())], ["tag", "outside", "inside"])


def labelled_weights(pages: DataFrame, rows: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from at most rows different pages that mark their article, chosen by a hash. Tags are counted where the pages lie; counts alone come to the driver."""
    marked = pages.filter(F.col("html").rlike("(?i)<article")).select(F.xxhash64("page_id", "html").alias("h"), "html")
    last = marked.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if last is None:
        return {}
    found = marked.filter(F.col("h") <= last).dropDuplicates(["h"]).mapInArrow(_counted, "tag string, outside long, inside long")
    return weights_of({r.tag: (r.outside, r.inside) for r in found.groupBy("tag").agg(F.sum("outside").alias("outside"), F.sum("inside").alias("inside")).collect()})


def extract_pages(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """pages with text (`text_` where they have a column of that name)."""

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        return pa.array([extract(x, weights) for x in text_array(column).to_pylist()], pa.string())

    return pages.withColumn(free_name(pages, "text"), text("html"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return extract_pages(pages, labelled_weights(pages.select("page_id", "html"))).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
