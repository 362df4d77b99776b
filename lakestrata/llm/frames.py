"""Small helpers the operators share: input columns, Arrow batches of bounded size, scratch tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestrata.session import scratch_dir

ROWS_PER_BATCH = 256
BYTES_PER_BATCH = 16 << 20


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, also where it holds dots or differs from another one only in case."""
    matches = [c for c in df.columns if c == name] or [c for c in df.columns if c.lower() == name.lower()]
    if len(matches) != 1:
        raise ValueError(f"{name}: {len(matches)} columns of that name")
    return df[f"`{matches[0].replace('`', '``')}`"]


def inputs(df: DataFrame, **names: str) -> DataFrame:
    """Only the columns an operator reads, under its own names: whatever else the table has cannot clash."""
    return df.select(*[column(df, name).alias(own) for own, name in names.items()])


def fresh(df: DataFrame, name: str) -> str:
    """A name no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Rows of text reach Python in batches that stay small however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def slices(batches: Iterator[pa.RecordBatch], of: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces whose texts (column number ``of``) hold ``most`` bytes, or one row more."""
    for batch in batches:
        start = size = 0
        for i, text in enumerate(batch.column(of)):
            size += len(text.as_buffer() or b"") if text.is_valid else 0
            if size >= most:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows written to a table in the shared scratch folder and read again: cuts lineage for good."""
    spark = df.sparkSession
    folder = folder or scratch_dir(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def table_bytes(df: DataFrame) -> int:
    """Bytes of the tables that a plan reads, whatever it makes of them; those that Spark cannot size count as none."""
    unknown = int(df.sparkSession._jsparkSession.sessionState().conf().defaultSizeInBytes())
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(s for s in sizes if s < unknown)
