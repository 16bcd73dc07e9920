"""Readers and writers of the corpus file formats."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import etl

PAIRS = "a bigint, b bigint"


def read_file_list(spark: SparkSession, path: str) -> list[str]:
    """Paths named in a file list, one to a line."""
    return [r["value"] for r in spark.read.text(path).filter(F.btrim("value") != "").collect()]


def read_corpus(spark: SparkSession, paths: list[str] | str, partitions: int | None = None) -> DataFrame:
    """(d, v, f) of 'docid idx:val ...' text files; gzip files are not split, so deal them anew."""
    lines = spark.read.text(paths)
    return etl.parse_lines(lines.repartition(partitions) if partitions else lines, "value")


def write_corpus(dw: DataFrame, path: str) -> None:
    """Write (d, v, f) as gzip text lines."""
    etl.render_lines(dw).select(F.col("line").alias("value")).write.option("compression", "gzip").text(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(v, w, c) of 'idx word count' lines."""
    return spark.read.schema("v bigint, w string, c bigint").option("sep", " ").csv(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(w, v) of 'word id' lines."""
    return spark.read.schema("w string, v bigint").option("sep", " ").csv(path)


def read_pairs(spark: SparkSession, path: str, left: str, right: str) -> DataFrame:
    """Two columns of numbers: document maps, word maps, label maps."""
    return spark.read.schema(PAIRS).option("sep", " ").csv(path).toDF(left, right)


def write_maps(rows: DataFrame, path: str) -> None:
    """Write (p, global, local) rows as one folder of pairs for each partition."""
    rows.write.partitionBy("p").option("sep", " ").csv(path)


def read_maps(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, p, local) of write_maps()."""
    rows = spark.read.schema(f"{key} bigint, local bigint, p bigint").option("sep", " ").csv(path)
    return rows.select(key, "p", "local")


def write_blocks(index: DataFrame, path: str) -> None:
    """Write (d_part, w_part, w_local, docs) as Parquet by part, so that a block is a folder of its own."""
    index.write.partitionBy("d_part", "w_part").parquet(path)


def read_block_table(spark: SparkSession, path: str) -> DataFrame:
    """(d_part, w_part, w_local, docs) of write_blocks()."""
    return spark.read.schema("w_local bigint, docs array<bigint>, d_part bigint, w_part bigint").parquet(path)


def read_links(spark: SparkSession, path: str, y: int, split: str) -> DataFrame:
    """(src, dst, y, split) of 'src n dst1 .. dstn' lines; n is checked against the line."""
    p = F.split(F.btrim("value"), " +")
    rows = spark.read.text(path).filter(F.btrim("value") != "").select(p.alias("p"))
    rows = rows.select(F.get("p", F.lit(0)).cast("bigint").alias("src"), F.explode(F.transform(F.slice("p", 3, F.get("p", F.lit(1)).cast("int")), lambda x: x.cast("bigint"))).alias("dst"))
    return rows.withColumn("y", F.lit(y)).withColumn("split", F.lit(split))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """(y, words array) of 'len label w1 .. wlen' lines; the first line, the count, is skipped."""
    p = F.split(F.btrim("value"), " +")
    rows = spark.read.text(path).select(p.alias("p")).filter(F.size("p") > 1)
    return rows.select(F.get("p", F.lit(1)).cast("int").alias("y"), F.transform(F.slice("p", 3, F.get("p", F.lit(0)).cast("int")), lambda x: x.cast("bigint")).alias("words"))


def read_months(spark: SparkSession, folder: str, start: str, end: str) -> DataFrame:
    """(ep, line, words array): documents of YYYY-MM.txt files from start up to but without end.

    Lines of fewer than nine bytes are dropped; line is an increasing number within a file.
    """
    names = [r[0] for r in spark.range(1).select(F.explode(etl.months(start, end))).collect()]
    out = None
    for ep, name in enumerate(names):
        rows = spark.read.text(f"{folder}/{name}.txt").withColumn("line", F.monotonically_increasing_id()).withColumn("ep", F.lit(ep).cast("bigint"))
        out = rows if out is None else out.unionByName(rows)
    words = F.transform(F.split(F.btrim("value"), " +"), lambda x: x.cast("bigint"))
    return out.filter(F.octet_length("value") >= 9).select("ep", "line", words.alias("words"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(path, w, docs array) of binary block files: two 32-bit sizes, a 64-bit row count, its offsets, 32-bit cells."""

    def run(batches):
        for pdf in batches:
            for name, body in zip(pdf.path, pdf.content):
                _, _, n = struct.unpack_from("<iiQ", body, 0)
                offsets = np.frombuffer(body, "<u8", n + 1, 16)
                cells = np.frombuffer(body, "<i4", int(offsets[-1]), 16 + 8 * (n + 1))
                yield pd.DataFrame({"path": name, "w": np.arange(n), "docs": [cells[int(a) : int(b)].tolist() for a, b in zip(offsets, offsets[1:])]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, w bigint, docs array<bigint>")


def block_bytes(n_docs: int, rows: list[list[int]]) -> bytes:
    """One block file of ascending document lists by word."""
    offsets = np.cumsum([0] + [len(r) for r in rows]).astype("<u8")
    return struct.pack("<iiQ", n_docs, len(rows), len(rows)) + offsets.tobytes() + np.array([x for r in rows for x in r], "<i4").tobytes()


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row, k, x) of a text matrix of log weights, less each column's last row."""
    rows = spark.read.text(path).withColumn("row", F.monotonically_increasing_id()).select("row", F.posexplode(F.split(F.btrim("value"), "[ \t]+")).alias("k", "x"))
    rows = rows.withColumn("x", F.col("x").cast("double"))
    last = rows.groupBy("k").agg(F.max_by("x", "row").alias("last"))
    return rows.join(F.broadcast(last), "k").select("row", "k", (F.col("x") - F.col("last")).alias("x"))


def write_topics(top: DataFrame, path: str) -> None:
    """Write (k, rank, w) as one line of words for each topic."""
    words = F.transform(F.sort_array(F.collect_list(F.struct("rank", "w"))), lambda x: x["w"])
    top.groupBy("k").agg(F.concat_ws(" ", words).alias("value")).orderBy("k").select("value").write.text(path)


def write_time_sliced(tokens: DataFrame, path: str) -> None:
    """Write (split, ep, d, v, f) as Parquet by split and epoch, so that a reader opens only what it asks for."""
    tokens.write.partitionBy("split", "ep").parquet(path)


def read_time_sliced(spark: SparkSession, path: str, split: str, epochs: int | None = None, most: int | None = None) -> DataFrame:
    """(ep, d, v, f) of a split; the first epochs only, and at most so many documents of each, if asked for."""
    rows = spark.read.schema("split string, ep bigint, d bigint, v bigint, f bigint").parquet(path).filter(F.col("split") == split).select("ep", "d", "v", "f")
    rows = rows if epochs is None else rows.filter(F.col("ep") < epochs)
    return rows if most is None else rows.join(etl.epoch_cap(rows.select("ep", "d").distinct(), most), ["ep", "d"], "left_semi")


def show_topics(top: DataFrame, path: str) -> None:
    """Write (ep, k, rank, w, p) as 'Topic k: (word: p) ...' lines, one folder for each epoch."""
    cell = lambda x: F.format_string("(%s: %.6f)", x["w"], x["p"])
    words = F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("rank", "w", "p"))), cell))
    lines = top.groupBy("ep", "k").agg(words.alias("x")).select(F.col("ep").cast("string").alias("ep"), F.concat(F.lit("Topic "), F.col("k").cast("string"), F.lit(": "), F.col("x")).alias("value"))
    lines.write.partitionBy("ep").text(path)


def write_parameters(phi: DataFrame, alpha: DataFrame, path: str) -> None:
    """Write word logits (ep, v, phi) by epoch and epoch means (ep, alpha) under a folder."""
    phi.write.partitionBy("ep").parquet(f"{path}/phi")
    alpha.write.parquet(f"{path}/alpha")


def split_input(spark: SparkSession, source: str, path: str, lines: int) -> None:
    """Deal text lines over gzip files of at most so many lines."""
    spark.read.text(source).select("value").write.option("maxRecordsPerFile", lines).option("compression", "gzip").text(path)
