"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition is a run of (digest, best row). Runs meet in rounds: in each round
FAN_IN neighbouring runs become one, rows of a digest in those runs are merged by a sorted
aggregation, and only the best row (longest original text, then smallest id) goes on to the
next round. After the last round one row per digest is left; the answer then goes down the
same tree, so each document learns the row that stays.

Rows of one digest that are in one run are merged before they are sent, and the key of an
exchange is (digest, run): a group of copies that holds a third of all rows is as many keys
as there are runs, at every level. No task sees a group whole.

A key is the SHA-256 of the normalised text with its length in code points and a second,
independent 64-bit hash: two texts count as equal only where all three agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import SPACE_CHARS, text_or_empty, written

FAN_IN = 16
KEY = ["digest", "norm_len", "check"]


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, norm_len, check, n_chars, run, uid) of each row; null text is empty.

    run is the input partition, uid a number that no other row has.
    """
    text = text_or_empty()
    norm = F.translate(text, SPACE_CHARS, "")
    rows = docs.select(
        F.col("doc_id"),
        F.length(text).cast("bigint").alias("n_chars"),
        norm.alias("norm"),
        F.spark_partition_id().cast("bigint").alias("run"),
        F.monotonically_increasing_id().alias("uid"),
    )
    return rows.select(
        "doc_id",
        F.unhex(F.sha2(F.encode("norm", "utf-8"), 256)).alias("digest"),
        F.length("norm").cast("bigint").alias("norm_len"),
        F.xxhash64("norm").alias("check"),
        "n_chars",
        "run",
        "uid",
    )


def merge_level(rows: DataFrame) -> DataFrame:
    """One row per key and run: the smallest best (longest, then smallest id) and the sum of n."""
    return rows.groupBy(*KEY, "run").agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def exact_dedup(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of docs (columns doc_id, text; any others are ignored).

    Returns doc_id, keep_id (id of the row that stays), group_size, kept, text_sha256 of the
    text without ASCII white space. Of equal texts the row with the most code points stays,
    then the one with the smallest doc_id (null ids last); of rows equal in both, exactly one
    is kept. Null and empty texts are equal. An empty table gives an empty table.
    """
    base = written(digests(docs), "digests")
    spark = docs.sparkSession
    runs = (base.agg(F.max("run").alias("m")).first()["m"] or 0) + 1
    best = F.struct((-F.col("n_chars")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("uid"))
    level = merge_level(base.select(*KEY, "run", best.alias("best"), F.lit(1).cast("bigint").alias("n")))
    levels = []
    while runs > 1:
        level = written(level, "runs")
        levels.append(level)
        level = merge_level(level.withColumn("run", F.floor(F.col("run") / fan_in)))
        runs = -(-runs // fan_in)
    won = level.select(*KEY, "run", "best", "n")
    for below in reversed(levels):
        down = below.select(*KEY, "run").withColumn("up", F.floor(F.col("run") / fan_in))
        won = down.join(won.withColumnRenamed("run", "up"), [*KEY, "up"]).drop("up")
    out = base.join(won, [*KEY, "run"])
    return out.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("uid") == F.col("best.uid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns, in any order.

    Rows are matched by id and digest, since ids may repeat; of rows that agree in both, the
    longest stays, once. Rows travel in a struct, so their columns may have any names.
    """
    keep = exact_dedup(docs).filter("kept").select("doc_id", F.col("text_sha256").alias("sha"))
    sha = F.sha2(F.encode(F.translate(text_or_empty(), SPACE_CHARS, ""), "utf-8"), 256)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), sha.alias("digest"))
    hit = rows.join(keep, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("digest") == F.col("sha")), "left_semi")
    return hit.groupBy("id", "digest").agg(F.max_by("row", F.length(F.coalesce("row.text", F.lit("")))).alias("row")).select("row.*")
