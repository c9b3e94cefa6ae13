"""Readers of the engine's input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str | Column) -> DataFrame:
    """`folder/name.parquet`, narrowed to `columns` so that the scan reads no others."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df
