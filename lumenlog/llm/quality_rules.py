"""Quality rules under weak supervision: each rule votes for a document, against it, or abstains; expectation-maximisation estimates from all documents, without
labels, how often each rule is right about good and about bad documents; the posterior probability of being good decides.

A document that the rules agree on stays, and one that a single shaky rule is against does too, where filtering by all rules would drop it. The model is
naive Bayes with two classes: a rule's chance of voting against a document depends on the class alone, an abstention says nothing. The number of
documents with each combination of votes (at most 3 ** rules, however many documents there are) is all that the estimation needs, so it counts every document.
Starting chances say that rules are seldom against good documents, which names the classes.

One scan of the texts, vectorised by Arrow batch; all later steps see counts. Words are runs of anything but blank and \\t-\\r. Defined results: null and empty texts have no
words; texts are counted whole; repeated rows are rows of their own; a null id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import IS_DARK, RunHasher, free_name, give_back, mix64, pieces, settle, spans, table, text_bytes

#: Counts of a text that rules look at; the first five are those of the contract.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_loud", "n_short", "n_ends", "n_spelt")
#: A document stays from this posterior probability on.
LEAST = 0.5
#: Chances of a vote against a good and a bad document that the estimation starts from, and how many documents' worth they weigh throughout.
START, WEIGHT = (0.02, 0.4), 10.0

_SAME = np.arange(256, dtype=np.uint8)
_IN_LINE = np.ones(256, bool)
_IN_LINE[10] = False


def _bytes(text: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(text, np.uint8)] = True
    return out


_SYMBOL, _LOUD, _END = _bytes(b"#*$%&|<>"), _bytes(b"!"), _bytes(b".!?")
_CAPITAL = _bytes(bytes(range(65, 91)))
_LETTER = _bytes(bytes([*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]))  # bytes that begin a letter beyond ASCII
_BEGINS = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


def count_texts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """COUNTS x texts."""
    n = len(offs) - 1
    starts, ends, where = spans(data, offs, IS_DARK)
    owner = np.repeat(np.arange(n), np.diff(where))
    run = lambda mask: np.concatenate([np.zeros(1, np.int64), np.cumsum(mask, dtype=np.int64)])
    by_text = lambda mask: np.diff(run(mask)[offs])
    by_word = lambda mask: np.bincount(owner[mask], minlength=n)
    points = run(_BEGINS[data])
    long = points[ends] - points[starts]
    hasher = RunHasher(data, _SAME)

    words = hasher(starts, ends)
    full = np.flatnonzero(owner[2:] == owner[:-2]) if len(words) > 2 else np.zeros(0, np.int64)
    window = mix64(mix64(mix64(words[full]) + words[full + 1]) + words[full + 2]) ^ mix64(owner[full].astype(np.uint64) + np.uint64(1))
    _, at, times = np.unique(window, return_inverse=True, return_counts=True)
    again = full[times[at] > 1]
    repeated = np.zeros(len(words), bool)
    for k in range(3):
        repeated[again + k] = True

    low, high, lines = spans(data, offs, _IN_LINE)
    dark = run(IS_DARK[data])
    owner_line, real = np.repeat(np.arange(n), np.diff(lines)), dark[high] > dark[low]
    low, high, owner_line = low[real], high[real], owner_line[real]
    different = np.unique(hasher(low, high) ^ mix64(owner_line.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
    n_lines = np.bincount(owner_line, minlength=n)
    n_dup = n_lines - np.bincount(owner_line[different], minlength=n)

    letters = run(_LETTER[data])
    chars = np.bincount(owner, weights=long, minlength=n).astype(np.int64)
    out = [np.diff(where), chars, by_text(_SYMBOL[data]), n_dup, by_word(repeated), n_lines, by_text(_LETTER[data]), by_text(_CAPITAL[data]), by_text(_LOUD[data]), by_word(long <= 3), by_word(_END[data[ends - 1]]), by_word(letters[ends] > letters[starts])]
    return np.stack(out).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [count_texts(d, o) for _, _, d, o in pieces(*text_bytes(batch.column("text")))]
        counts = np.concatenate(found, 1) if found else np.zeros((len(COUNTS), 0), np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(x) for x in counts)], ["doc_id", *COUNTS])
    give_back()


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_counted, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.nullif(F.col(b), F.lit(0))


def _rule(value: Column, good: Column, bad: Column) -> Column:
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The rules over COUNTS: 1 for the document, -1 against it, 0 abstains. Bounds are those that heuristics of web corpora use, with room between both votes."""
    length, symbols, repeats, capitals, loud = _share("word_chars", "n_words"), _share("n_symbols", "n_words"), _share("n_repeat_words", "n_words"), _share("n_capitals", "n_letters"), _share("n_loud", "n_words")
    lines, letters, short, ends = _share("n_dup_lines", "n_lines"), _share("n_letters", "word_chars"), _share("n_short", "n_words"), _share("n_ends", "n_words")
    words, spelt = F.col("n_words"), _share("n_spelt", "n_words")
    return {
        "enough_words": _rule(words, words >= 100, words < 50),
        "word_length": _rule(length, length.between(3, 10), (length < 2.5) | (length > 12)),
        "few_symbols": _rule(symbols, symbols < 0.05, symbols > 0.1),
        "few_repeats": _rule(repeats, repeats < 0.15, repeats > 0.3),
        "lower_case": _rule(capitals, capitals < 0.2, capitals > 0.4),
        "calm": _rule(loud, loud < 0.05, loud > 0.2),
        "own_lines": _rule(F.when(F.col("n_lines") > 3, lines), lines < 0.1, lines > 0.3),
        "letters": _rule(letters, letters > 0.8, letters < 0.65),
        "spelt_words": _rule(spelt, spelt > 0.9, spelt < 0.8),
        "short_words": _rule(short, short.between(0.1, 0.7), (short < 0.03) | (short > 0.9)),
        "sentences": _rule(F.when(words >= 50, ends), ends.between(0.02, 0.3), (ends < 0.005) | (ends > 0.6)),
    }


@dataclass
class RuleModel:
    """prior: share of good documents; against: by rule, its chance of voting against a good and a bad one."""

    prior: float
    against: Mapping[str, tuple[float, float]]

    def posterior(self, votes: Mapping[str, Column]) -> Column:
        odds = F.lit(float(np.log(self.prior / (1 - self.prior))))
        for name, (good, bad) in self.against.items():
            odds = odds + F.when(votes[name] < 0, float(np.log(good / bad))).when(votes[name] > 0, float(np.log((1 - good) / (1 - bad)))).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def estimate(votes: np.ndarray, n: np.ndarray, names: list[str], rounds: int = 500) -> RuleModel:
    """Expectation-maximisation over combinations of votes (combinations x rules) and their numbers of documents."""
    minus, plus = (votes < 0).astype(float), (votes > 0).astype(float)
    chance, prior = np.tile(np.array(START)[:, None], (1, votes.shape[1])), 0.5
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + minus @ np.log(chance[0] / chance[1]) + plus @ np.log((1 - chance[0]) / (1 - chance[1]))
        good = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        was = chance
        against = np.stack([(n * w) @ minus for w in (good, 1 - good)])
        voted = against + np.stack([(n * w) @ plus for w in (good, 1 - good)])
        chance = np.clip((against + WEIGHT * np.array(START)[:, None]) / (voted + WEIGHT), 1e-6, 1 - 1e-6)
        prior = float(np.clip((n @ good + WEIGHT / 2) / (n.sum() + WEIGHT), 1e-6, 1 - 1e-6))
        if np.abs(chance - was).max() < 1e-9:
            break
    return RuleModel(prior, {name: (float(g), float(b)) for name, g, b in zip(names, *chance, strict=True)})


def rule_model(counts: DataFrame) -> RuleModel:
    """The model of all documents' counts. Its driver gets a row for each combination of votes, 3 ** rules at most."""
    votes = rules()
    told = counts.groupBy(*(v.alias(k) for k, v in votes.items())).agg(F.count("*").alias("n")).orderBy(*votes).toPandas()
    return estimate(told[list(votes)].to_numpy(float).reshape(-1, len(votes)), told["n"].to_numpy(float), list(votes))


def judged(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, COUNTS, base_failed, posterior (the probability of being good), kept."""
    counts = settle(counted(docs), "counts")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = counts.select("*", failed.alias("base_failed"), rule_model(counts).posterior(rules()).alias("posterior"))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))


def with_quality(docs: DataFrame, model: RuleModel) -> DataFrame:
    """docs with the posterior probability, as `quality` (with underscores where docs have that name), scored in place and without a join."""
    name, schema = free_name(docs, "quality"), "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"

    def count(column: pa.Array) -> pa.Array:
        found = [count_texts(d, o) for _, _, d, o in pieces(*text_bytes(column))]
        counts = np.concatenate(found, 1) if found else np.zeros((len(COUNTS), 0), np.int64)
        return pa.StructArray.from_arrays([pa.array(x) for x in counts], list(COUNTS))

    inner = free_name(docs, "_counts")
    rows = docs.withColumn(inner, F.arrow_udf(count, schema)("text"))
    whole = F.struct(*docs.columns).alias("row")
    scored = rows.select(whole, f"{inner}.*").withColumn("q", model.posterior(rules()))
    return scored.select("row.*", F.col("q").alias(name))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and whether it stays."""
    return judged(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", *COUNTS[:5], "base_failed", "kept", "posterior")


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op13_quality_rules: the counts, and that no document which fails the base is kept."""
    return op13_quality_rules(spark, sf_dir).select("doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") | ~F.col("kept")).alias("sound"))


COUNTS_SQL = r"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 2),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM t WHERE n > 1) GROUP BY doc_id),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols,
  list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS real FROM d)
SELECT doc_id, n_words, word_chars, n_symbols, (len(real) - len(list_distinct(real)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed, true AS sound FROM c LEFT JOIN r USING (doc_id)"""
