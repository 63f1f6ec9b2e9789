"""Sinks: run records, describe summaries, accepted artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_records(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write run records (NULL fields are omitted by the JSON writer, matching absent keys)."""
    df.write.mode("overwrite").format(fmt).save(path)


def write_summary(df: DataFrame, path: str) -> None:
    """Write a small labelled summary table (bounded rows, e.g. 8 describe rows) as one header CSV."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_accepted(df: DataFrame, path: str, partition_col: str = "project", fmt: str = "parquet") -> None:
    """Write accepted artifacts partitioned by project, so readers prune by directory."""
    df.write.mode("overwrite").partitionBy(partition_col).format(fmt).save(path)
