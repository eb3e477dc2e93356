"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from termweave.runtime import staging_path


def write_staging(df: DataFrame, name: str, path: str | None = None) -> str:
    """Rebuild a staged table and return its path (below the shared folder by default)."""
    target = path or staging_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(target)
    return target


def export(df: DataFrame, path: str) -> str:
    """The complete result as CSV part files with a header each."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path
