"""URL filters: explicit rules by longest match; for all other urls the host is split into words by unigram Viterbi and
a multinomial naive Bayes model scores the words of host and path.

The unigrams are counted over all urls: the words of paths, and the parts of host labels that a hyphen splits, as whole labels may be names yet to
be split; the VOCABULARY most frequent count. No table labels urls: the urls that rules decide are labelled by what the rules say (a language,
say), not by what a name says, and fitted to them the model would block clean pages of a language. So the classes are fitted to seed names.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule and is judged by the prior (allow);
repeated rows are judged alike, each on its own; an empty table gives no rows and the seeds' unigrams; other columns are ignored. Words of one letter say nothing. One small aggregate, then map-only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import table

#: (host, path, action).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

#: Words of the urls that segmentation knows, at most (those of the seeds besides), and the least number of urls with a word.
VOCABULARY, LEAST_URLS = 50_000, 2

#: Labelled seed names and paths that the classes are fitted to, split into their words.
BLOCK_SEEDS = (
    "casino win", "online casino bonus", "casino royal slots", "free bets", "sports betting tips", "best bets", "poker jackpot", "lucky slots win", "lottery winner", "roulette spin casino",
    "cheap pills", "pills online pharmacy", "viagra cheap", "buy cialis cheap", "diet pills", "adult chat", "adult video xxx", "porn tube", "xxx sex cams", "nude girls", "sex dating hookup", "escort adult",
    "spam farm", "link farm spam", "spam links", "ads track", "ad server", "ads popup banner", "track click ads", "tracker pixel", "click tracking", "malware download", "phishing login", "warez crack keygen",
    "torrent crack", "replica watches cheap", "payday loans", "quick loans cash", "win cash prize", "hacked accounts",
)
ALLOW_SEEDS = (
    "news daily", "blog", "my blog", "docs", "city library", "school news", "university research", "science journal", "history museum", "music lessons", "art gallery", "book review", "book club", "weather report",
    "garden plants", "travel guide", "cooking recipes", "food blog", "health advice", "sports club", "open source", "software docs", "data science", "math forum", "community forum", "wiki", "film review", "photo album",
    "local paper", "world news", "green energy", "water works", "bird watch", "home repair", "family farm", "free library", "language course", "kids games", "law office", "space station", "town council", "train times",
    "article archive", "category index", "about contact", "help pages", "static images", "search page",
)


class UrlModel:
    """Word segmentation by unigrams, of the seeds and of words with counts, and naive Bayes fitted to labelled seeds. A plain, picklable object of a bounded size."""

    def __init__(self, block: Sequence[str] = BLOCK_SEEDS, allow: Sequence[str] = ALLOW_SEEDS, prior_block: float = 0.2, alpha: float = 0.5, words: Mapping[str, int] | None = None):
        counts = [Counter(w for s in seeds for w in s.split()) for seeds in (allow, block)]
        named = sorted(counts[0] | counts[1])
        known = counts[0] + counts[1] + Counter(words or {})
        self.total, self.longest = sum(known.values()), max(map(len, known), default=1)
        self.unigram = {w: math.log(n / self.total) for w, n in known.items()}
        sums = [sum(c.values()) + alpha * len(named) for c in counts]
        self.odds = {w: math.log((counts[1][w] + alpha) / sums[1]) - math.log((counts[0][w] + alpha) / sums[0]) for w in named if len(w) > 1}
        self.prior = math.log(prior_block / (1 - prior_block))

    def segment(self, name: str) -> list[str]:
        """The likeliest split of a name into words (Viterbi over positions). Adjoining unknown pieces cost more than one."""
        best, back = [0.0], [0]
        far, ten = 0, math.log(10)
        for end in range(1, len(name) + 1):
            # An unknown word of n letters has probability 10 / (total * 10**n); it may start anywhere, a known one within the longest's reach.
            # Of the starts beyond that reach one is the best for all later ends, so the time is linear in the name.
            score, start, near = -math.inf, 0, max(0, end - self.longest)
            if near and best[near - 1] + (near - 1) * ten > best[far] + far * ten:
                far = near - 1
            for begin in (far, *range(near, end)) if near else range(end):
                known = self.unigram.get(name[begin:end]) if end - begin <= self.longest else None
                p = known if known is not None else math.log(10 / self.total) - (end - begin) * math.log(10)
                if best[begin] + p > score:
                    score, start = best[begin] + p, begin
            best.append(score)
            back.append(start)
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return out[::-1]

    def log_odds(self, host: str, path: str, segment=None) -> float:
        """Log-odds of block. Words that the seeds lack say nothing."""
        segment = segment or self.segment
        words = [w for label in re.split(r"[^a-z0-9]+", host) if label for w in segment(label)] if host else []
        words += [w for w in re.split(r"[^a-z0-9]+", path.lower()) if w]
        return self.prior + sum(self.odds.get(w, 0.0) for w in words)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where there is no `://`."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text (host + path) and its action, null where none fits. Of equally long ones the first in text order."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, a in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]), reverse=True):  # the outermost test comes last
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(a)).otherwise(action)
    return rule, action


def url_words(pages: DataFrame, rows: int = VOCABULARY, least: int = LEAST_URLS) -> dict[str, int]:
    """In how many urls each word comes: words of paths, and parts of host labels with a hyphen. The rows most frequent, ties in text order."""
    host, path = url_parts(F.col("url"))
    labels = F.filter(F.split(host, r"[^a-z0-9-]+"), lambda x: x.contains("-"))
    found = F.array_distinct(F.split(F.concat_ws(" ", labels, F.lower(path)), "[^a-z0-9]+"))
    counts = pages.select(F.explode(found).alias("word")).filter("word rlike '[a-z]'").groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return {r.word: r.n for r in counts.orderBy(F.desc("n"), "word").limit(rows).collect()}


def judge_urls(pages: DataFrame, model: UrlModel | None = None, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.0) -> DataFrame:
    """page_id, host, path, rule, verdict, log_odds (null where a rule decides). Block where the log-odds exceed the threshold. Without a model, one with the urls' own words."""
    model = model or UrlModel(words=url_words(pages))

    @F.pandas_udf("double")
    def odds(host: pd.Series, path: pd.Series) -> pd.Series:
        segment = lru_cache(1 << 14)(model.segment)
        return pd.Series([None if h is None else model.log_odds(h, p, segment) for h, p in zip(host, path, strict=True)], dtype="float64")

    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, action = longest_rule(F.col("host"), F.col("path"), rules)
    judged = parts.select("page_id", "host", "path", rule.alias("rule"), action.alias("action"))
    open_host = F.when(F.col("rule").isNull(), F.col("host"))  # what a rule decides isn't scored
    out = judged.select("*", odds(open_host, "path").alias("log_odds"))
    learned = F.when(F.col("log_odds") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", learned).alias("verdict"), "log_odds")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url, by the rules and else by the model."""
    return judge_urls(table(spark, sf_dir, "pages", "page_id", "url"))
