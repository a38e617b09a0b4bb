"""Table sources: every table is one Parquet path below a folder that only Spark needs to reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table `name` of the folder `sf_dir` (any file system that Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
