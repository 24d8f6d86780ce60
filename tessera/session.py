"""Session settings that the library is written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | None = None, memory: str = "16g") -> SparkSession:
    """A local session for the bench and for trying things; on a cluster the caller brings its own."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{n}]").appName("tessera").config(map=SETTINGS)
    session = builder.config("spark.sql.shuffle.partitions", str(n)).config("spark.ui.enabled", "false").config("spark.driver.memory", memory).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
