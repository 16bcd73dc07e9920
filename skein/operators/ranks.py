"""Running totals over a global order without a global window.

Rows are range-partitioned by the order and written; each range adds the totals of those
before it. Only one number per range is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.state import written


def running_sum(df: DataFrame, order: list[str], value: Column, out: str) -> DataFrame:
    """df with out: the sum of value over the rows up to and including this one in the order.

    The order must tell rows apart, or equal rows take their places as they come.
    """
    cut = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_p", F.spark_partition_id()).withColumn("_v", value)
    cut = written(cut, "ranges")
    sizes = cut.groupBy("_p").agg(F.sum("_v").alias("_s"))
    before = sizes.select("_p", (F.sum("_s").over(Window.orderBy("_p")) - F.col("_s")).alias("_b"))
    inside = F.sum("_v").over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return cut.withColumn("_i", inside).join(F.broadcast(before), "_p").withColumn(out, F.col("_i") + F.col("_b")).drop("_p", "_v", "_i", "_b")


def numbers_within(df: DataFrame, group: str, order: str, out: str) -> DataFrame:
    """df with out: the place, from 1, of each row in its group (a number) by order, which tells rows apart.

    Places are running totals over ranges of (group, order), less the rows of the groups before:
    no task holds a group. The table of groups is one row each.
    """
    placed = row_numbers(df, [group, order], out)
    sizes = placed.groupBy(group).agg(F.min(out).alias("_first"))
    return placed.join(sizes, group).withColumn(out, F.col(out) - F.col("_first") + 1).drop("_first")


def row_numbers(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with out: the place of each row in the order, from 1."""
    return running_sum(df, order, F.lit(1).cast("bigint"), out)
