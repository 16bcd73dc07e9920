"""Topic count matrices and the likelihoods computed from them.

Counts of a document or a word over K topics are kept as one array<bigint> of length K
per row, so a (document, word) row meets its two count rows by two equi-joins and the
topic axis never multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assign(dw: DataFrame, k: int) -> DataFrame:
    """z(d, v, f, z): a reproducible topic for each of the f occurrences, z array<bigint>.

    The n-th occurrence (from 1) of word v in document d takes (7919 d + 104729 v + 1299709 n) mod k.
    """
    topic = F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("f")), lambda n: (F.col("d") * 7919 + F.col("v") * 104729 + n * 1299709) % k)
    return dw.withColumn("z", topic)


def histogram(topics: Column, k: int) -> Column:
    """Occurrences of 0..k-1 in an array of topics."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda t: F.size(F.filter(topics, lambda x: x == t)).cast("bigint"))


def long_counts(z: DataFrame, row: str) -> DataFrame:
    """(row, k, c): tokens of each topic by document (row='d') or word (row='v')."""
    return z.select(row, F.explode("z").alias("k")).groupBy(row, "k").agg(F.count(F.lit(1)).alias("c"))


def dense_counts(z: DataFrame, row: str, k: int) -> DataFrame:
    """(row, c): one array<bigint> of k counts per document or word."""
    one = z.select(row, F.explode("z").alias("k"))
    return one.groupBy(row).agg(F.array(*[F.count(F.when(F.col("k") == t, 1)) for t in range(k)]).alias("c"))


def topic_totals(z: DataFrame, k: int) -> DataFrame:
    """One row (c): array<bigint> of tokens per topic."""
    return z.select(F.explode("z").alias("k")).agg(F.array(*[F.count(F.when(F.col("k") == t, 1)) for t in range(k)]).alias("c"))


def perplexity(z: DataFrame, k: int, alpha: float, beta: float) -> DataFrame:
    """(pairs, ntok, nv, perplexity) of the topic assignment z.

    p(v|d) = sum_k (cdk + alpha)(cvk + beta) / (ck + beta V) / (L_d + alpha K). The totals
    are one row of K numbers, hence the broadcast.
    """
    cdk = dense_counts(z, "d", k).withColumnRenamed("c", "cd")
    cvk = dense_counts(z, "v", k).withColumnRenamed("c", "cv")
    ck = topic_totals(z, k).select(F.col("c").alias("ck")).crossJoin(F.broadcast(z.agg(F.count_distinct("v").alias("nv"))))
    rows = z.select("d", "v", "f").join(cdk, "d").join(cvk, "v").crossJoin(F.broadcast(ck))
    terms = [(F.col("cd")[t] + F.lit(alpha)) * (F.col("cv")[t] + F.lit(beta)) / (F.col("ck")[t] + F.lit(beta) * F.col("nv")) for t in range(k)]
    length = F.aggregate("cd", F.lit(0).cast("bigint"), lambda a, x: a + x)
    p = sum(terms[1:], terms[0]) / (length + F.lit(alpha * k))
    return rows.select("f", "nv", p.alias("p")).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.sum("f").alias("ntok"),
        F.max("nv").alias("nv"),
        F.round(F.exp(-F.sum(F.col("f") * F.log("p")) / F.sum("f")), 6).alias("perplexity"),
    )
