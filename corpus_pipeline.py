"""The corpus pipeline: documents through quality, toxicity, near-dedup, decontamination and mixing.

Every stage takes (spark, docs, sf_dir) and returns documents with the columns of the table; the last adds `copy`, the number
of the repetition, for documents that the mix takes more than once (`copy_` where documents have a column `copy`). Columns of documents with
names that the stages use themselves (score, predicted, removed_words, key, ...) come out as they went in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import free_name, settle, table
from lumenlog.llm.decontaminate import decontaminate
from lumenlog.llm.mixing import mix_rows
from lumenlog.llm.near_dedup import keep_one
from lumenlog.llm.quality import score_quality, train_quality
from lumenlog.llm.toxicity import score_toxicity, train_toxicity


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier accepts."""
    model = train_quality(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return score_quality(docs, model).filter(F.col(free_name(docs, "predicted")) == 1).select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the toxicity classifier passes."""
    model = train_toxicity(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return score_toxicity(docs, model).filter(F.col(free_name(docs, "predicted")) == 0).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates."""
    return keep_one(docs, rare=0, sets=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of the benchmark; documents that are mostly such go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text")).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their target weights: documents as often as it takes them."""
    return mix_rows(docs)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]

#: SQL can't express the trained and hashed stages; tests/llm/test_stages.py holds each stage, on what the one before kept, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, name)
    return docs
