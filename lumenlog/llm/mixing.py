"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length within each source; a source's budget is first spent in proportion over the
lengths, bounded-knapsack dynamic programming over the remaining documents fits what is left (at most an eighth of it, as a rule), and of each length as many
documents as planned are chosen by a seeded hash.

Defined results: a null or empty text has size 0 and is never taken; the null source comes last; repeated rows are documents of
their own, and rows that agree in id, source and size are interchangeable; equal hashes go by doc_id; an empty table gives no
rows; a source of size 0 has target 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlog.llm.common import SALTS, free_name, settle, table

#: Words of a source's budget that are kept back for the dynamic program, at most; it takes memory in proportion.
RESERVE = 1 << 15
#: Rows of one (source, length, slot) group that are ranked together, on average.
SLOT_ROWS = 512


def text_size(text: Column) -> Column:
    """Number of runs of anything but blank and \\t-\\r, which is what Java calls \\S; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def water_level(sources: DataFrame, budget: Fraction, most: float = 2) -> Fraction | None:
    """The share u of a weight: a source (size, weight) gets the lesser of u * weight and most * size, and these sum to the budget. None where no
    source is left below most * size. Each round is one aggregate over the sources, and gives at least one more its most."""
    level: Fraction | None = Fraction(0)
    full, known = 0, None
    while True:
        over = F.col("size") * float(most) < F.lit(float(level)) * F.col("weight")
        told = sources.agg(F.sum(F.when(over, F.col("size"))).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("free"), F.count_if(over).alias("full")).first()
        if known is not None and told.full == full:
            return level
        full, known = told.full, True
        if not told.free:
            return None
        level = (budget - Fraction(most) * (told.capped or 0)) / Fraction(told.free)


def fit_budget(lengths: Sequence[int], counts: Sequence[int], budget: int, reserve: int = RESERVE) -> list[int]:
    """How many documents of each length to take, so that their lengths sum to the budget, or as close below it as can be found.

    Lengths are distinct and positive. First 7/8 of the budget (all but the reserve, where an eighth exceeds it) is spent in proportion to the lengths' totals;
    the rest is a bounded knapsack. Where that misses the budget, less is spent in proportion, down to nothing where the reserve allows
    it, and the closest sum counts.
    """
    if budget >= sum(n * c for n, c in zip(lengths, counts, strict=True)):
        return list(counts)
    held, best = min(reserve, max(budget // 8, 1)), None
    while True:
        take = _fit(lengths, counts, budget, held, reserve)
        spent = sum(n * t for n, t in zip(lengths, take, strict=True))
        if best is None or spent > best[0]:
            best = spent, take
        if best[0] == budget or held >= min(budget, reserve):
            return best[1]
        held = min(2 * held, budget, reserve)


def _fit(lengths: Sequence[int], counts: Sequence[int], budget: int, held: int, reserve: int) -> list[int]:
    """Spends all but held words of the budget in proportion, carrying roundings on from longer to shorter lengths, and the rest by a bounded
    knapsack: reachable sums as bits of one integer, counts split into powers of two."""
    order = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    total = sum(lengths[k] * counts[k] for k in order)
    take = [0] * len(lengths)
    goal, carry = Fraction(max(0, budget - held)), Fraction(0)
    for k in order:
        want = goal * lengths[k] * counts[k] / total + carry
        take[k] = min(counts[k], int(want // lengths[k]))
        carry = want - take[k] * lengths[k]
    left = budget - sum(t * n for t, n in zip(take, lengths, strict=True))
    for k in order:  # long documents may leave more than the program should hold
        if left > 2 * reserve and (more := min(counts[k] - take[k], (left - reserve) // lengths[k])) > 0:
            take[k] += more
            left -= more * lengths[k]
    reach, steps, mask = 1, [], (1 << (left + 1)) - 1
    for k in order:
        room, part = min(counts[k] - take[k], left // lengths[k]), 1
        while room > 0 and not reach >> left & 1:
            n = min(part, room)
            steps.append((k, n, reach))
            reach |= (reach << n * lengths[k]) & mask
            room, part = room - n, part * 2
    at = reach.bit_length() - 1
    for k, n, before in reversed(steps):
        if not before >> at & 1:
            take[k] += n
            at -= n * lengths[k]
    return take


def _plan(reserve: int):
    """For applyInPandas over a source's histogram: base (whole passes) and extra (documents that come once more) of each size."""

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        base, real = int(target // total) if total else 0, pdf["size"] > 0
        pdf["base"], pdf["extra"] = np.where(real, base, 0).astype("int64"), np.int64(0)
        if real.any():
            pdf.loc[real, "extra"] = fit_budget(pdf["size"][real].tolist(), pdf["n"][real].tolist(), int(target) - base * total, reserve)
        return pdf[["source", "size", "n", "source_size", "target", "base", "extra"]]

    return plan


def numbered_sources(totals: DataFrame) -> DataFrame:
    """totals (source, ...) with source_no: places by code point, null last. Range partitions are counted, and a window inside each numbers its
    sources; the driver sees one count for each partition."""
    ranged = settle(totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranged")
    parts, before, firsts = sorted((r["part"], r["count"]) for r in ranged.groupBy("part").count().collect()), 0, {}
    for part, n in parts:
        firsts[part], before = before, before + n
    first = F.element_at(F.create_map(*(F.lit(x) for pair in firsts.items() for x in pair)), F.col("part")) if firsts else F.lit(0)
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return ranged.withColumn("source_no", (first + inside - 1).cast("long")).drop("part")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2, seed: int = 11, reserve: int = RESERVE) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies: what a mix of share times all words takes of each document.

    Sources in code-point order (null last) take the weights in turn. One scan of the texts; all later steps see ids, sizes and a hash only.
    The histogram of a source has a row for each distinct length, so it is bounded by the longest document, not by the rows. Rows of one
    source and length are dealt over tasks by parts of the hash in every join and ranking.
    """
    u = F.xxhash64(F.lit(seed), "doc_id", "text", F.lit(1))
    sizes = settle(docs.select("doc_id", "source", text_size(F.col("text")).alias("size"), u.alias("u")).withColumn("salt", F.pmod("u", F.lit(SALTS)).cast("int")), "sizes")
    counts = settle(sizes.groupBy("source", "size", "salt").agg(F.count("*").alias("n")), "lengths")
    lengths = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    totals = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    known = settle(numbered_sources(totals).select("source", "source_size", weight.alias("weight")), "sources")
    budget = Fraction(share) * (known.agg(F.sum("source_size")).first()[0] or 0)
    level = water_level(known.select(F.col("source_size").alias("size"), "weight"), budget, most)
    target = F.col("source_size") * float(most) if level is None else F.least(F.col("source_size") * float(most), F.col("weight") * float(level))
    aimed = known.select(F.col("source").alias("of"), "source_size", target.alias("target"))
    histogram = lengths.join(aimed, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    plan = settle(histogram.groupBy("source").applyInPandas(_plan(reserve), "source string, size long, n long, source_size long, target double, base long, extra long"), "plan")

    spread = counts.select(F.col("source").alias("of"), F.col("size").alias("long"), F.col("salt").alias("part")).join(plan, F.col("of").eqNullSafe(F.col("source")) & (F.col("long") == F.col("size"))).drop("source", "size")
    planned = sizes.join(spread, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("long")) & (F.col("salt") == F.col("part"))).drop("of", "long", "part")
    # A length's documents fall into slots by hash; slots are taken whole up to the one where the count is reached, whose rows are ranked.
    some = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    slot = F.floor((F.shiftrightunsigned("u", 1).cast("double") / F.lit(float(1 << 63))) * F.ceil(F.col("n") / SLOT_ROWS)).cast("long")
    planned = planned.withColumn("slot", slot)
    before = Window.partitionBy("source", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = planned.filter(some).groupBy("source", "size", "slot").agg(F.count("*").alias("rows_here")).withColumn("rows_before", F.coalesce(F.sum("rows_here").over(before), F.lit(0)))
    slots = slots.select(F.col("source").alias("of"), F.col("size").alias("long"), F.col("slot").alias("at"), "rows_before")
    ranked = planned.join(slots, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("long")) & (F.col("slot") == F.col("at")), "left")
    rank = F.row_number().over(Window.partitionBy("source", "size", "slot").orderBy("u", "doc_id"))
    chosen = F.when(F.col("extra") >= F.col("n"), 1).when(some & (F.col("rows_before") + F.col("rank_here") <= F.col("extra")), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.col("base") + chosen).otherwise(0).cast("long")
    return ranked.withColumn("rank_here", rank).select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs that it takes, as often as it takes them, with `copy` from 0 (`copy_` where docs have a column copy). Rows with a
    null id join as equal.

    The plan's copies of rows that agree in id, source and size differ by one at most, so that their sum tells them all: where they differ,
    the rows are numbered by text, and the first ones come once more.
    """
    group = ["taken_id", "taken_source", "taken_size"]
    taken = mix_sources(docs, **options).groupBy(*(F.col(c).alias(g) for c, g in zip(("doc_id", "source", "size"), group))).agg(F.sum("copies").alias("all_copies"), F.count("*").alias("all_rows"))
    taken = settle(taken.filter("all_copies > 0").select(*group, F.expr("all_copies div all_rows").alias("copies"), F.expr("all_copies % all_rows").alias("more")), "taken")
    whole = docs.select("doc_id", "source", text_size(F.col("text")).alias("size"), F.struct(*docs.columns).alias("row"))
    on = F.col("doc_id").eqNullSafe(F.col("taken_id")) & F.col("source").eqNullSafe(F.col("taken_source")) & (F.col("size") == F.col("taken_size"))
    # The plan has a row for each id: by sort and merge at every size, not broadcast while it is small.
    even, uneven = taken.filter("more = 0").hint("merge"), taken.filter("more > 0").hint("merge")
    rows = whole.join(even, on).select("row", "copies")
    if not uneven.isEmpty():
        nth = F.row_number().over(Window.partitionBy(*group).orderBy("row.text"))
        numbered = whole.join(uneven, on).withColumn("copies", F.col("copies") + (nth <= F.col("more")).cast("long"))
        rows = rows.unionByName(numbered.filter("copies > 0").select("row", "copies"))
    return rows.select("row.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias(free_name(docs, "copy")))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix_sources(table(spark, sf_dir, "documents", "doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken", "source")
