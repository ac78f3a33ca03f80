"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenlog.llm.chat_format import OP9_SQL, op9_chat_format
from lumenlog.llm.decontaminate import OP6_SQL, op6_decontaminate
from lumenlog.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from lumenlog.llm.html_extract import op8_html_extract
from lumenlog.llm.manifest import OP11_SQL, op11_merkle_manifest
from lumenlog.llm.media_chunks import op5_media_chunks
from lumenlog.llm.mixing import op1_mix_sources
from lumenlog.llm.near_dedup import op7_near_dedup
from lumenlog.llm.quality import op3_quality
from lumenlog.llm.quality_rules import COUNTS_SQL, op13_quality_rules, rule_counts
from lumenlog.llm.token_counts import op4_token_counts
from lumenlog.llm.toxicity import op10_toxicity
from lumenlog.llm.url_filter import op2_url_filter



def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op2_url_filter that SQL can express: host, path and rule."""
    return op2_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule")


def mix_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op1_mix_sources that SQL can express: sizes of documents and sources, and whether takes are whole and at most twice."""
    rows = op1_mix_sources(spark, sf_dir)
    return rows.selectExpr("doc_id", "size", "source_size", "taken % greatest(size, 1) = 0 AND taken BETWEEN 0 AND 2 * size AS fair")


QUERIES = {
    "url_rules": url_rules,
    "mix_sizes": mix_sizes,
    "op1_mix_sources": op1_mix_sources,
    "op2_url_filter": op2_url_filter,
    "op3_quality": op3_quality,
    "op4_token_counts": op4_token_counts,
    "op5_media_chunks": op5_media_chunks,
    "op6_decontaminate": op6_decontaminate,
    "op7_near_dedup": op7_near_dedup,
    "op8_html_extract": op8_html_extract,
    "op9_chat_format": op9_chat_format,
    "op10_toxicity": op10_toxicity,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_quality_rules": op13_quality_rules,
    "rule_counts": rule_counts,
}

SQL = {
    "op6_decontaminate": OP6_SQL,
    "op9_chat_format": OP9_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "rule_counts": COUNTS_SQL,
    "url_rules": r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(h, q) AS (VALUES ('org', '/'), ('example.org', '/es/'), ('example.org', '/en/1'), ('com', '/fr/'), ('com', '/de/'))
SELECT page_id, host, path, (SELECT arg_max(h || q, len(h || q)) FROM r WHERE (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, q)) AS rule FROM p""",
    "mix_sizes": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents)
SELECT doc_id, size, sum(size) OVER (PARTITION BY source)::BIGINT AS source_size, true AS fair FROM d""",
}
