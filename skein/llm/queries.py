"""The opN_<name> queries, each over its whole table, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, exact_dedup, html_text, language_id, mixing, near_dup, ngram_lm, oracle, pii, quality_model, quality_rules
from skein.llm.common import read


def fold(modulus: int, value: int) -> Column:
    """Whether crc32 of the id as text leaves value modulo modulus; false for a null id."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % modulus == value, F.lit(False))


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; a fifth of the ids is never learned from."""
    return quality_model.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), fold(5, 0))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of all documents and their decoded texts, as digests."""
    out = bpe.encode_and_decode(read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of documents, by a tree merge of digest runs."""
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents to target weights, in training order."""
    out = mixing.mix(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    out = html_text.extract(read(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op7_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff scores of all documents under the corpus's own counts."""
    out = ngram_lm.score_documents(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("log10_score", 6).alias("log10_score"), F.round("log10_per_word", 8).alias("log10_per_word"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the divergence verdict for every document."""
    out = quality_rules.quality_rules(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents; a quarter of the ids is never learned from."""
    return language_id.identify(read(spark, sf_dir, "documents"), fold(4, 2))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of personal data in all documents, and the spans."""
    out = pii.find_pii(read(spark, sf_dir, "documents"))
    line = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint")
    base = F.filter("found", lambda x: x["kind"].isin(*pii.BASE))
    return out.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in pii.BASE],
        F.sha2(F.encode(line(base), "utf-8"), 256).alias("base_sha256"),
        line(F.col("found")).alias("spans"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of this subpackage."""
    found = (op1_quality_model, op2_bpe, op3_exact_dedup, op4_mixing, op5_near_dup, op6_html_text, op7_ngram_lm, op8_quality_rules, op9_language_id, op10_pii)
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """Oracle SQL by query name."""
    return {
        "op3_exact_dedup": oracle.EXACT_DEDUP,
        "op4_mixing": oracle.MIXING,
        "op7_ngram_lm": oracle.NGRAM_LM,
        "op8_quality_rules": oracle.quality_rules_sql(),
    }
