"""SQL text as transforms over registered tables."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lakestrata.sources import fs


def read_sql(spark: SparkSession, path: str) -> str:
    """Text of a SQL file, where Spark would find it, else from the driver's disk."""
    if "://" not in path and not fs.exists(spark, path):
        return Path(path).read_text(encoding="utf-8")
    return fs.read_text(spark, path)


def target_name(path: str) -> str:
    """A SQL file is named after the table it makes."""
    return path.rsplit("/", 1)[-1].removesuffix(".sql")


def run_sql(
    spark: SparkSession, text: str, args: Mapping[str, Any] | None = None, **frames: DataFrame
) -> DataFrame:
    """Run a query with bound values (``:name``, ``IDENTIFIER(:name)``) and DataFrames (``{name}``).

    Nothing is spliced into the text.
    """
    return spark.sql(text, args=dict(args) if args else None, **frames)


def run_sql_file(
    spark: SparkSession,
    path: str,
    views: Mapping[str, DataFrame] | None = None,
    args: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Register the inputs under the names the file uses and run it."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return run_sql(spark, read_sql(spark, path), args)


def execute_query(spark: SparkSession, query: str) -> DataFrame:
    """Run any statement; commands take effect at once, queries stay lazy."""
    return spark.sql(query)


def share_view(df: DataFrame, name: str) -> str:
    """Register a view other sessions of the application can read, and give its full name."""
    df.createOrReplaceGlobalTempView(name)
    return f"global_temp.{name}"


LATEST_SQL = """
    SELECT * EXCEPT (__rank)
    FROM (
        SELECT *, row_number() OVER (
            PARTITION BY IDENTIFIER(:key) ORDER BY IDENTIFIER(:ts) DESC, IDENTIFIER(:tie) DESC
        ) AS __rank
        FROM {rows}
    )
    WHERE __rank = 1
"""
