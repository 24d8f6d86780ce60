"""What the queries' modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of ``sf_dir``; with columns, just those."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
