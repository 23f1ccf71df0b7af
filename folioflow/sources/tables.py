"""The driver's parquet tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.session import importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
