"""Readers with explicit schemas, so no inference pass is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from termweave import schemas


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def read_observations(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Sample-level rows: T code and term, M code and term, sample number and time."""
    return _read(spark, path, schemas.OBSERVATIONS, fmt)


def read_code_counts(spark: SparkSession, path: str, layout: str, fmt: str = "parquet") -> DataFrame:
    """Pre-aggregated rows in the ``years``, ``count`` or ``span`` layout."""
    return _read(spark, path, schemas.CODE_COUNTS[layout], fmt)


def read_bridge(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, schemas.BRIDGE, fmt)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the harmonised tables."""
    return spark.read.schema(schemas.TABLES[name]).parquet(path)
