"""Session construction for tests, the bench and interactive use.

On a cluster the session comes from the launcher; nothing in the library sets
master, memory or shuffle parallelism on a session it is given.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "skein", cores: int | None = None, shuffle: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with adaptive execution on and UTC time."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "0")) or os.cpu_count() or 4
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle or cores))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
