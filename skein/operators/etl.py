"""Corpus preparation: parsing, partition maps, inverted index, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import kernels
from skein.operators.ranks import numbers_within, row_numbers
from skein.sources.state import written


#: Words, 16 bytes each, that the driver may deal over partitions.
MAX_WORDS = 20_000_000


def render_lines(dw: DataFrame) -> DataFrame:
    """(line): one 'd v:f v:f ...' line per document, words ascending."""
    cells = F.sort_array(F.collect_list(F.struct("v", "f")))
    text = F.concat_ws(" ", F.transform("c", lambda x: F.concat_ws(":", x["v"].cast("string"), x["f"].cast("string"))))
    return dw.groupBy("d").agg(cells.alias("c")).select(F.concat_ws(" ", F.col("d").cast("string"), text).alias("line"))


def parse_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """(d, v, f) of 'd v:f v:f ...' lines; any document id that is a number, empty lines skipped."""
    parts = F.split(F.btrim(F.translate(column, ":", " ")), " +")
    rows = lines.filter(F.btrim(F.col(column)) != "").select(parts.alias("p")).filter(F.size("p") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("p") - 2, F.lit(2)), lambda i: F.struct(F.get("p", i).cast("bigint").alias("v"), F.get("p", i + 1).cast("bigint").alias("f")))
    return rows.select(F.get("p", F.lit(0)).cast("bigint").alias("d"), F.explode(pairs).alias("x")).select("d", "x.v", "x.f")


def expand_occurrences(dw: DataFrame) -> DataFrame:
    """(d, v, n): a row per occurrence, n from 1."""
    return dw.filter("f > 0").select("d", "v", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("f"))).alias("n"))


def term_frequency(dw: DataFrame) -> DataFrame:
    """(v, tf): occurrences of each word."""
    return dw.groupBy("v").agg(F.sum("f").alias("tf"))


def document_map(docs: DataFrame, parts: int) -> DataFrame:
    """(d, p, local): partition of each document by id, and its dense number there."""
    p = F.pmod(F.col("d") * 2654435761, F.lit(parts)).cast("bigint")
    placed = numbers_within(docs.select("d", p.alias("p")), "p", "d", "n")
    return placed.select("d", "p", (F.col("n") - 1).alias("local"))


def word_map(tf: DataFrame, parts: int) -> DataFrame:
    """(v, p, local): words dealt, heaviest first, to the lightest partition, and numbered there.

    The greedy order is inherently serial and covers the vocabulary, not the corpus: it runs
    on the driver over (v, tf), and refuses more than MAX_WORDS words.
    """
    spark = tf.sparkSession
    tf = written(tf, "tf")
    if tf.count() > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} words; cut the vocabulary first")
    table = tf.orderBy(F.desc("tf"), F.desc("v")).toArrow()
    bins = kernels.lightest_bins(table.column("tf").to_numpy(), parts)
    import pyarrow as pa

    dealt = spark.createDataFrame(pa.table({"v": table.column("v"), "p": pa.array(bins)}))
    order = Window.partitionBy("p").orderBy((F.col("v") * 7919) % 1_000_003, "v")
    return dealt.withColumn("local", F.row_number().over(order).cast("bigint") - 1)


def inverted_index(dw: DataFrame) -> DataFrame:
    """(v, docs): ascending document ids of each word, repeated by occurrence."""
    lists = F.flatten(F.transform("c", lambda x: F.array_repeat(x["d"], x["f"].cast("int"))))
    return dw.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("d", "f"))).alias("c")).select("v", lists.alias("docs"))


def blocks(dw: DataFrame, docmap: DataFrame, wordmap: DataFrame) -> DataFrame:
    """(d_part, w_part, d_local, w_local, f): the two-dimensional partition grid."""
    left = dw.join(docmap.select("d", F.col("p").alias("d_part"), F.col("local").alias("d_local")), "d")
    return left.join(wordmap.select("v", F.col("p").alias("w_part"), F.col("local").alias("w_local")), "v").select("d_part", "w_part", "d_local", "w_local", "f")


def column_words(tokens: DataFrame, columns: int, column: int) -> DataFrame:
    """The tokens of one of so many vocabulary columns: words by their id modulo columns."""
    return tokens.filter(F.pmod("v", F.lit(columns)) == column)


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with y by labels (d, y); -1 for a document that has none."""
    return docs.join(labels.select("d", F.col("y").cast("int").alias("y")), "d", "left").withColumn("y", F.coalesce("y", F.lit(-1)))


def index_blocks(grid: DataFrame) -> DataFrame:
    """(d_part, w_part, w_local, docs) of blocks(): a word's ascending documents in one document part, repeated by occurrence."""
    lists = F.flatten(F.transform("c", lambda x: F.array_repeat(x["d_local"], x["f"].cast("int"))))
    held = F.sort_array(F.collect_list(F.struct("d_local", "f"))).alias("c")
    return grid.groupBy("d_part", "w_part", "w_local").agg(held).select("d_part", "w_part", "w_local", lists.alias("docs"))


def from_blocks(index: DataFrame, docmap: DataFrame, wordmap: DataFrame) -> DataFrame:
    """(d, v, f) of index_blocks(), by the maps that made them."""
    cells = index.select("d_part", "w_part", "w_local", F.explode("docs").alias("d_local")).groupBy("d_part", "w_part", "w_local", "d_local").agg(F.count(F.lit(1)).alias("f"))
    cells = cells.join(docmap.select("d", F.col("p").alias("d_part"), F.col("local").alias("d_local")), ["d_part", "d_local"])
    return cells.join(wordmap.select("v", F.col("p").alias("w_part"), F.col("local").alias("w_local")), ["w_part", "w_local"]).select("d", "v", "f")


def epoch_ranges(spark: SparkSession, loads: DataFrame, parts: int) -> DataFrame:
    """(ep, load, part): contiguous parts of the epochs with the least greatest load; one row per epoch on the driver."""
    table = loads.orderBy("ep").toArrow()
    part = kernels.contiguous_ranges(table.column("load").to_numpy(), parts)
    import pyarrow as pa

    return spark.createDataFrame(pa.table({"ep": table.column("ep"), "load": table.column("load"), "part": pa.array(part)}))


def train_test(docs: DataFrame, share: float = 0.8) -> DataFrame:
    """docs with split 'tr' for the first floor(share n) documents of each epoch, else 'te'."""
    placed = numbers_within(docs, "ep", "d", "_place")
    sizes = docs.groupBy("ep").agg(F.count(F.lit(1)).alias("_n"))
    first = F.col("_place") <= F.floor(F.col("_n") * F.lit(share))
    return placed.join(sizes, "ep").withColumn("split", F.when(first, "tr").otherwise("te")).select(*docs.columns, "split")


def held_out(tokens: DataFrame) -> DataFrame:
    """tokens with seen: true for the first floor(len / 2) places of each document."""
    n = F.count(F.lit(1)).over(Window.partitionBy("d"))
    return tokens.withColumn("seen", F.col("pos") < F.floor(n / 2))


def epoch_cap(docs: DataFrame, most: int, seed: int = 17) -> DataFrame:
    """At most `most` documents of each epoch, by a reproducible pseudo-random order."""
    order = Window.partitionBy("ep").orderBy((F.col("d") * 104729 + seed) % 1_000_003, "d")
    return docs.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).drop("_r")


def months(start: str, end: str) -> Column:
    """Array of 'YYYY-MM' from start up to but without end."""
    first, last = F.to_date(F.lit(start + "-01")), F.add_months(F.to_date(F.lit(end + "-01")), -1)
    return F.transform(F.sequence(first, last, F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))


def k_folds(rows: DataFrame, key: str, k: int) -> DataFrame:
    """rows with fold 0..k-1: equal runs of a reproducible pseudo-random order."""
    placed = row_numbers(rows.withColumn("_k", (F.col(key) * 7919) % 1_000_003), ["_k", key], "_n")
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("_t")))
    return placed.crossJoin(total).withColumn("fold", F.expr(f"(_n - 1) * {k} div _t")).drop("_k", "_n", "_t")
