"""Readers of the parquet tables of one scale directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``: a parquet file or a directory of parquet files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
