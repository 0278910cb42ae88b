"""Table scans. Paths go to Spark's readers only, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the standard tables below ``sf_dir``; columns and filters are pruned by Catalyst."""
    return spark.read.parquet(table_path(sf_dir, name))
