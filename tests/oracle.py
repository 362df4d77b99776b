"""Compare a Spark result with DuckDB's, columns by name and rows in any order."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def canonical(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_plain(row[i]) for i in order]) for row in rows)


def spark_rows(df) -> tuple[list[str], list[str]]:
    return sorted(df.columns), canonical(df.columns, df.collect())


def duck_rows(connection, sql: str) -> tuple[list[str], list[str]]:
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    return sorted(columns), canonical(columns, result.fetchall())
