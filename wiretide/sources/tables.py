"""Parquet tables of earlier results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*[c for c in columns if c in df.columns])


def shape(df: DataFrame) -> tuple[int, list[str]]:
    """Row count and columns."""
    return df.count(), df.columns
