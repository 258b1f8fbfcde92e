"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; Spark's reader sees only the columns and filters that a query needs."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
