"""Merkle dataset manifest: hashes of all documents in one tree, and a recursive query that climbs from every document to the root.

A document is a leaf: the hash of its fields. Per source, leaves ascend by doc_id (nulls first, equal ids by leaf); every three nodes in turn become
their hash until one, the subroot, remains; subroots, by source (null first, by bytes), become the root in the same way. Built levels are stored as
node rows (id, children, parent, place), each linked to its parent; the top node of a source's tree to the run of subroots that it is in. WITH RECURSIVE then takes every leaf
up these links: each step joins the climbers with the nodes, appends the siblings of the step as a row of the proof and folds the hash. A manifest so proves each
document by itself: a changed one folds to another root.

Leaves are numbered through range partitions, of which the driver sees one count each; runs of three are grouped by number, so a hot source spreads over
all tasks as any other. What a step shuffles are ids and one hash a leaf; the upper levels, of at most UPPER nodes, are broadcast.

Defined results: nulls in any column have a mark of their own, so differ from empty texts; texts are hashed whole; rows with the same id are ordered by
leaf, so equal rows are interchangeable; a lone leaf is its own subroot and a lone subroot the root, with the hash of nothing as a lone leaf's proof;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import discard, join_hot, salt_of, settle, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a run.
FAN = 3
#: Level of the subroots in node ids; trees of sources stay below it, as positions have 56 bits.
TOP = 40
#: Upper nodes that are broadcast, at most: some 8 MB.
UPPER = 1 << 16


def digest(*fields: Column) -> Column:
    """SHA-256 of fields, as bytes: `-` for null, else the number of UTF-8 bytes, `:` and the value."""
    told = (F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields)
    return F.unhex(F.sha2(F.concat(*told).cast("binary"), 256))


def joined(hashes: Column) -> Column:
    """The hash of hashes, taken as hex text one after another."""
    return F.unhex(F.sha2(F.array_join(F.transform(hashes, lambda h: F.lower(F.hex(h))), "").cast("binary"), 256))


def tampered_text(docs: DataFrame) -> Column:
    """The text without its line ends where 2 divides crc32 of the id."""
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return F.when(even, F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"])


def numbered(df: DataFrame, tag: str, *order: str) -> DataFrame:
    """df, settled, with `at`: the place of each row in the order, from 0. Range partitions are sorted, and the driver sees one count for each."""
    here = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), here.alias("nth")), tag)
    before, firsts = 0, {}
    for r in sorted(ranged.groupBy("part").count().collect(), key=lambda r: r["part"]):
        firsts[r["part"]], before = before, before + r["count"]
    first = F.element_at(F.create_map(*(F.lit(x).cast("long") for pair in firsts.items() for x in pair)), F.col("part").cast("long")) if firsts else F.lit(0)
    out = ranged.select(*df.columns, (first + F.col("nth")).alias("at"))
    out.settled_at = ranged.settled_at
    return out


def node_id(level: int, at: Column) -> Column:
    """The id of a node: its level and the place of its first leaf among all leaves (from TOP: among the sources)."""
    return F.lit(level << 56) + at


def linked(level: int, base: int, several: bool) -> tuple[Column, Column]:
    """parent and place of nodes (first, n, s, at) on a level of trees whose leaves are on base. The top of a tree goes on among the subroots where there are several."""
    span = FAN ** (level - base)
    run = F.floor((F.col("at") - F.col("first")) / (FAN * span))
    inside = F.col("n") > span
    above = node_id(TOP + 1, F.col("s") - F.col("s") % FAN) if several else F.lit(None).cast("long")
    parent = F.when(inside, node_id(level + 1, F.col("first") + run * (FAN * span))).otherwise(above)
    return parent, F.when(inside, F.floor((F.col("at") - F.col("first")) / span) % FAN).otherwise(F.col("s") % FAN).cast("int")


def grown(leaves: DataFrame, base: int, several: bool) -> tuple[list[DataFrame], DataFrame]:
    """Levels over leaves (first, n, s, at, hash), settled as nodes; and the last node of each tree (s, hash). first and n: a tree's first leaf and number of
    leaves, s: its number among the sources."""
    most, level, span = leaves.agg(F.max("n")).first()[0] or 0, base, 1
    levels, tops, at = [], leaves.filter("n = 1").select("first", "s", "hash"), leaves
    while span < most:
        run = F.floor((F.col("at") - F.col("first")) / (FAN * span))
        runs = at.filter(F.col("n") > span).groupBy("first", "n", "s", (F.col("first") + run * (FAN * span)).alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "hash")))["hash"].alias("children"))
        level, span = level + 1, span * FAN
        parent, place = linked(level, base, several)
        at = settle(runs.select("*", joined(F.col("children")).alias("hash"), node_id(level, F.col("at")).alias("id"), parent.alias("parent"), place.alias("place")), "level")
        levels.append(at)
        tops = tops.unionByName(at.filter(F.col("n") <= span).select("first", "s", "hash"))
    return levels, tops


def steps_up(spark: SparkSession, starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The climb of starts (at, depth, parent, place, folded) by a recursive query as far as nodes go: a row for the start and for each step, with the siblings met."""
    return spark.sql(
        """WITH RECURSIVE climb(at, depth, parent, place, siblings, folded) AS (
          SELECT at, depth, parent, place, CAST(array() AS ARRAY<BINARY>), folded FROM {starts}
          UNION ALL
          SELECT c.at, c.depth + 1, n.parent, n.place, concat(slice(n.children, 1, c.place), slice(n.children, c.place + 2, 3)),
            unhex(sha2(CAST(array_join(transform(concat(slice(n.children, 1, c.place), array(c.folded), slice(n.children, c.place + 2, 3)), h -> lower(hex(h))), '') AS BINARY), 256))
          FROM climb c JOIN {nodes} n ON c.parent = n.id)
        SELECT * FROM climb""",
        starts=starts,
        nodes=nodes,
    )


def climbed(spark: SparkSession, starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """at, proof_sha256, folded_root of starts (at, parent, place, start). On the first level, and up to that above which at most UPPER nodes lie, climbers are shuffled to the
    nodes of a step; those few upper nodes are broadcast."""
    rows = "spark.sql.cteRecursionRowLimit"
    was = spark.conf.get(rows)
    split, above = 1, 0
    for r in nodes.groupBy(F.shiftright("id", 56).alias("level")).count().orderBy(F.desc("level")).collect():  # a row for each level
        above += r["count"]
        if above > UPPER:
            split = r["level"]
            break
    bound = F.lit((split + 1) << 56)
    try:
        spark.conf.set(rows, -1)  # the recursion ends with the tree's height
        at = starts.select("at", F.lit(0).alias("depth"), "parent", "place", F.col("start").alias("folded"))
        lower = settle(steps_up(spark, at, nodes.filter(F.col("id") < bound)), "lower")
        at = lower.filter(F.coalesce(F.col("parent") >= bound, F.lit(True))).drop("siblings")
        steps = steps_up(spark, at, F.broadcast(nodes.filter(F.col("id") >= bound))).unionByName(lower).select("at", "depth", "siblings", "folded")
        path = F.array_sort(F.collect_list(F.struct("depth", "siblings")))
        whole = steps.groupBy("at").agg(F.lower(F.hex(joined(F.flatten(path["siblings"])))).alias("proof_sha256"), F.lower(F.hex(F.max_by("folded", "depth"))).alias("folded_root"))
        out = settle(whole, "climbed")
    finally:
        spark.conf.set(rows, was)
    discard(lower)
    return out


def manifest(docs: DataFrame, changed: Column | None = None) -> tuple[DataFrame, str | None]:
    """One row for each document: doc_id, source, leaf, subroot, root, proof_sha256, folded_root (of the text changed, where given), verified; and the root."""
    spark = docs.sparkSession
    docs = docs.select(*FIELDS)
    leaf = digest(*(F.col(c) for c in FIELDS))
    start = leaf if changed is None else F.when(changed.eqNullSafe(F.col("text")), leaf).otherwise(digest(*(F.col(c) for c in FIELDS[:-1]), changed))
    tree = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # null first, all else by bytes
    hashed = settle(docs.select("doc_id", "source", tree.alias("tree"), leaf.alias("hash"), start.alias("start")).withColumn("salt", salt_of("hash")), "hashed")
    placed = numbered(hashed, "placed", "tree", "doc_id", "hash")
    trees = numbered(placed.groupBy("tree").agg(F.min("at").alias("first"), F.count("*").alias("n")), "trees", "tree").withColumnRenamed("at", "s")
    sources = trees.count()
    if not sources:
        return placed.select("doc_id", "source", *(F.lit(None).cast("string").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), F.lit(False).alias("verified")), None
    leaves = settle(join_hot(placed, trees, ["tree"], "salt"), "leaves")
    levels, subroots = grown(leaves.select("first", "n", "s", "at", "hash"), 0, sources > 1)
    subroots = settle(subroots, "subroots")
    upper, roots = grown(subroots.select(F.lit(0).cast("long").alias("first"), F.lit(sources).cast("long").alias("n"), F.lit(0).cast("long").alias("s"), F.col("s").alias("at"), "hash"), TOP, False)
    root = roots.select(F.lower(F.hex("hash"))).first()[0]
    blank = spark.createDataFrame([], "id long, parent long, place int, children array<binary>")
    nodes = blank
    for x in (*levels, *upper):
        nodes = nodes.unionByName(x.select(blank.columns))
    nodes = settle(nodes, "nodes")
    parent, place = linked(0, 0, sources > 1)
    proofs = climbed(spark, leaves.select("at", parent.alias("parent"), place.alias("place"), "start"), nodes)
    told = join_hot(leaves, subroots.select("first", F.lower(F.hex("hash")).alias("subroot")), ["first"], "salt")
    out = told.join(proofs, "at").select("doc_id", "source", F.lower(F.hex("hash")).alias("leaf"), "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
    discard(hashed, placed, *levels, *upper)
    return out, root


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot, root and proof, and what its tampered text folds to."""
    docs = table(spark, sf_dir, "documents", *FIELDS)
    return manifest(docs, tampered_text(docs))[0].drop("source")


def _field(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::VARCHAR)) || ':' || {column}::VARCHAR, '-')"


_HEAD = " || ".join(_field(c) for c in FIELDS[:-1])
#: The table of crc32's remainders comes from eight halvings of 0 to 255; ids are folded over it digit by digit.
OP11_SQL = f"""WITH RECURSIVE bits AS (SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, source, text, {_HEAD} AS head, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c // 256, t[(xor(c, b) % 256)::INT + 1])), 4294967295) % 2 = 0 AS even FROM documents, crc),
l AS (SELECT doc_id, source, sha256(head || {_field("text")}) AS leaf, CASE WHEN even AND contains(text, chr(10)) THEN sha256(head || {_field("replace(text, chr(10), '')")}) ELSE sha256(head || {_field("text")}) END AS start FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
s AS (SELECT source, n, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS no, count(*) OVER () AS sources FROM (SELECT DISTINCT source, n FROM p)),
tree AS (SELECT s.no, 0 AS level, p.pos, p.leaf AS hash, p.n AS width FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source
  UNION ALL SELECT no, level + 1, pos // 3, sha256(string_agg(hash, '' ORDER BY pos)), (any_value(width) + 2) // 3 FROM tree WHERE width > 1 GROUP BY no, level, pos // 3),
subs AS (SELECT no, hash FROM tree WHERE width = 1),
top AS (SELECT 0 AS level, no AS pos, hash, (SELECT count(*) FROM subs) AS width FROM subs
  UNION ALL SELECT level + 1, pos // 3, sha256(string_agg(hash, '' ORDER BY pos)), (any_value(width) + 2) // 3 FROM top WHERE width > 1 GROUP BY level, pos // 3),
nodes AS (SELECT no, level, pos, hash FROM tree WHERE width > 1 UNION ALL SELECT -1, level, pos, hash FROM top WHERE width > 1),
runs AS (SELECT no, level, pos // 3 AS run, list(hash ORDER BY pos) AS hashes FROM nodes GROUP BY ALL),
start AS (SELECT p.doc_id, p.leaf, p.start, p.pos, s.no, row_number() OVER () AS id FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source),
heights AS (SELECT no, max(level) + 1 AS height FROM nodes GROUP BY no),
climb AS (SELECT id, no AS own, CASE WHEN h.height IS NULL THEN -1 ELSE no END AS no, 0 AS level, CASE WHEN h.height IS NULL THEN no ELSE pos END AS pos, start AS folded, '' AS proof FROM start LEFT JOIN heights h USING (no)
  UNION ALL SELECT id, own, CASE WHEN c.no >= 0 AND c.level + 1 = h.height THEN -1 ELSE c.no END, CASE WHEN c.no >= 0 AND c.level + 1 = h.height THEN 0 ELSE c.level + 1 END,
    CASE WHEN c.no >= 0 AND c.level + 1 = h.height THEN own ELSE c.pos // 3 END,
    sha256(array_to_string(list_concat(hashes[:c.pos % 3], [folded], hashes[c.pos % 3 + 2:]), '')), proof || array_to_string(list_concat(hashes[:c.pos % 3], hashes[c.pos % 3 + 2:]), '')
  FROM climb c JOIN runs r ON r.no = c.no AND r.level = c.level AND r.run = c.pos // 3 JOIN heights h ON h.no = c.no),
ended AS (SELECT * FROM climb c LEFT JOIN heights h USING (no) WHERE no = -1 AND level = coalesce(height, 0))
SELECT doc_id, leaf, subs.hash AS subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM start JOIN subs ON subs.no = start.no JOIN ended ON ended.id = start.id, (SELECT hash AS root FROM top WHERE width = 1)"""
