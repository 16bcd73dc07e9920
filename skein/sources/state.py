"""Model state between iterations as tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in spark.checkpoint.dir, reread: cuts the lineage durably."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="skein-state-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Remove tables that written() made and no later step reads."""
    for df in tables:
        if df is not None and (path := getattr(df, "_skein_path", None)):
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps that are over: Spark removes them once the driver's objects are collected."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
