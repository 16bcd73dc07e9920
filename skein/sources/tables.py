"""Adapters from the driver's tables to the library's standard relations.

tokens(d, pos, w)   one row per word of a document
vocab(v, w)         dense word ids in byte order of the word
dw(d, v, f)         occurrences of word v in document d
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.sources.state import written

SMALL_BYTES = 128 << 20
WORD_BREAK = "[^a-z0-9]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the scale-factor folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(docs: DataFrame) -> DataFrame:
    """docs dealt over all cores where the input is small; large inputs have splits enough as they are.

    A file's row groups are its tasks, however many cores wait: cutting a few megabytes of text
    into words in one task takes longer than sending them. Beyond SMALL_BYTES nothing is sent.
    """
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(docs.sparkSession.sparkContext.defaultParallelism) if size < SMALL_BYTES else docs


def tokens(docs: DataFrame) -> DataFrame:
    """Words of each document, lower-cased, with their position from 0."""
    words = F.filter(F.split(F.lower("text"), WORD_BREAK), lambda w: w != "")
    return spread(docs.select("doc_id", "text")).select(F.col("doc_id").alias("d"), F.posexplode(words).alias("pos", "w"))


def vocab(toks: DataFrame) -> DataFrame:
    """Dense word ids by byte order.

    The rank is global, so the distinct words are range-partitioned and sorted and each
    partition adds the sizes of those before it; no task sees the whole vocabulary.
    """
    return dense_rank_by(toks.select("w").distinct(), "w", "v")


def dense_rank_by(df: DataFrame, key: str, out: str) -> DataFrame:
    """Number the rows of df from 0 in the order of its unique column key.

    Two-level: a row number inside a leading-byte bucket plus the bucket's offset. The
    buckets are the first two bytes of the key, so the offset table has a fixed bound.
    """
    bucket = F.substring(F.encode(F.col(key), "utf-8"), 1, 2)
    keyed = df.withColumn("_b", F.hex(bucket))
    sizes = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    offs = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_off"))
    rn = F.row_number().over(Window.partitionBy("_b").orderBy(key)).cast("bigint")
    return keyed.withColumn("_r", rn).join(offs, "_b").select((F.col("_off") + F.col("_r") - 1).alias(out), key)


def doc_words(toks: DataFrame) -> DataFrame:
    """(d, w, f): occurrence counts per document and word."""
    return toks.groupBy("d", "w").agg(F.count(F.lit(1)).alias("f"))


def corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(dw(d, v, f), vocab(v, w)) of the documents table."""
    # Texts are cut into words once: the vocabulary is that of the counts.
    pairs = written(doc_words(tokens(table(spark, sf_dir, "documents"))), "pairs")
    words = vocab(pairs)
    return pairs.join(words, "w").select("d", "v", "f"), words
