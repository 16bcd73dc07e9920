"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import drop, written


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node of edges points at one node that points at none."""
    if edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").head(1):
        return False
    return not edges.select("v").distinct().join(edges.select(F.col("u").alias("v")), "v", "left_semi").head(1)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of edges (u, v): comp is the smallest node of its component.

    Each round points a node's larger neighbours, then its smaller ones, at the smallest; a
    component becomes a star in a number of rounds that grows with the logarithm of its size.
    Minima are partial aggregates, written before they are joined back: both sides of the join
    are then exchanges of their own, and adaptive execution splits a node with very many
    neighbours over tasks. Each round is a written table; rounds end when every component is a star.
    """
    flat = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now = written(flat, "edges")
    while not _is_stars(now):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "edges")
        drop(low)
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after = written(small, "edges")
        for old in (now, large, low):
            drop(old)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
