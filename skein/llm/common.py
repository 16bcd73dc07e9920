"""What the corpus operators share: paths, tables that cut lineage, column helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: ASCII white space, [\x20\x09-\x0D], as the contracts name it.
SPACE = "[\\x20\\x09-\\x0D]"
NOT_SPACE = "[^\\x20\\x09-\\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor reaches.

    Where the session has none, as in tests, a local one is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bound_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Have Arrow batches to Python hold about size bytes at most, unless the session asks for fewer.

    Rows of whole texts or sets are of very unlike sizes; a number of rows bounds no memory.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m").lower().rstrip("b")
    now = int(now.rstrip("kmg")) << {"k": 10, "m": 20, "g": 30}.get(now[-1], 0)
    if not 0 < now <= size:
        spark.conf.set(key, str(size))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, reread: cuts the lineage.

    Lost executors cost nothing that is in the table, and unlike a checkpoint it is read
    with column pruning. The caller may remove it with drop() when no plan needs it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a table that written() made."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._skein_path)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps that are over.

    Spark removes them when the driver's objects for them are collected, which in a long
    driver program may be late.
    """
    gc.collect()
    spark._jvm.System.gc()


def text_or_empty(name: str = "text") -> Column:
    """The column with null read as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def word_array(text: Column) -> Column:
    """The maximal runs of characters outside [\\x20\\x09-\\x0D], in order."""
    # Leading white space would give one empty first piece, trailing one is cut by the trim.
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters outside [\\x20\\x09-\\x0D]."""
    return F.size(word_array(text)).cast("bigint")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row.

    A plain reference inside a lambda is evaluated for every element, also when it names a
    column of a projection below that the optimiser merges; a lambda's own variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
