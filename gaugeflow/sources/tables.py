"""Reading the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a folder (a file or a folder of files)."""
    return spark.read.parquet(table_path(folder, name))


def table_path(folder: str, name: str) -> str:
    """Where the table lies."""
    return f"{folder.rstrip('/')}/{name}.parquet"
