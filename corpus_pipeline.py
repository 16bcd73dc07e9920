"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing, tokenising.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before has kept, and
returns a DataFrame that is written as Parquet and read again as the next one's docs. All
but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import bpe, exact_dedup, mixing, near_dup, quality_rules
from skein.llm.common import read, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.kept_documents(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact copies."""
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dup.kept_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix of its source meets it."""
    return mixing.mixed_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each document, as packed 32-bit integers, and their number."""
    out = bpe.encode_and_decode(docs)
    return out.selectExpr("doc_id", "ids", "cast(octet_length(ids) div 4 as bigint) as n_tokens")


STAGES = [
    ("quality_rules", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]

#: SQL cannot express the near-duplicate classes at this size nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the last one's result."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
