"""Evaluation: AUC with ties, accuracy, top words, perplexity of held-out tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.ranks import running_sum


def auc(scored: DataFrame) -> DataFrame:
    """One row (auc, positives, negatives) of (score, y), y in 0 / 1; ties share their mean rank.

    Scores are counted first; their ranks are running totals over ranges of the score.
    """
    by = scored.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("bigint")).alias("pos"))
    ranked = running_sum(by, ["score"], F.col("n"), "upto").withColumn("mean_rank", F.col("upto") - (F.col("n") - 1) / F.lit(2.0))
    sums = ranked.agg(F.sum(F.col("mean_rank") * F.col("pos")).alias("s"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    p, q = F.col("p").cast("double"), F.col("q").cast("double")
    return sums.select(F.round((F.col("s") - p * (p + 1) / 2) / (p * q), 9).alias("auc"), F.col("p").alias("positives"), F.col("q").alias("negatives"))


def accuracy(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row (n, accuracy)."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col(truth) == F.col(guess)).cast("double")), 9).alias("accuracy"))


def top_words(cells: DataFrame, group: list[str], value: str, k: int) -> DataFrame:
    """The k greatest cells of each group with their rank from 1; ties by word id.

    A group's cells are first cut to k inside salted parts, so no task sorts a whole group.
    """
    salted = Window.partitionBy(*group, "_salt").orderBy(F.desc(value), "v")
    cut = cells.withColumn("_salt", F.col("v") % 64).withColumn("_r", F.row_number().over(salted)).filter(F.col("_r") <= k)
    final = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(value), "v"))
    return cut.withColumn("rank", final).filter(F.col("rank") <= k).drop("_salt", "_r")


def topic_words(top: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """top (.., v, rank) with w, the word of each id by vocabulary (v, w); an id without one is its own word.

    top has K times the number of ranks rows and is the smaller side.
    """
    return top.join(vocabulary.select("v", "w"), "v", "left").withColumn("w", F.coalesce("w", F.col("v").cast("string")))


def heldout_perplexity(tokens: DataFrame, phi: DataFrame, theta: DataFrame) -> DataFrame:
    """One row (tokens, perplexity): tokens (ep, d, v, f), phi (ep, v, phi array), theta (d, theta array)."""
    p = F.aggregate(F.zip_with("phi", "theta", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    rows = tokens.join(phi, ["ep", "v"]).join(theta, "d").select("f", p.alias("p"))
    return rows.agg(F.sum("f").alias("tokens"), F.round(F.exp(-F.sum(F.col("f") * F.log("p")) / F.sum("f")), 6).alias("perplexity"))
