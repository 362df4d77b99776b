"""Batch and streaming reads of raw files in any Spark format."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestrata.sources import fs

CORRUPT = "_corrupt_record"
ARRIVED, ARRIVED_FILE = "__arrived", "__arrived_file"
CSV_DEFAULTS = {"header": "true", "inferSchema": "true"}


_PACKED = ["", ".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate"]


def files_of(path: str, data_format: str) -> str:
    """Glob for the files, packed or not, or batch folders, of a format directly in a folder."""
    suffixes = ["text", "txt"] if data_format == "text" else [data_format]
    return f"{path}/*.{{{','.join(s + p for s in suffixes for p in _PACKED)}}}"


def _require_suffixes(spark: SparkSession, path: str) -> None:
    """A file without a suffix belongs to no format: an error rather than left out unseen."""
    odd = [n for n in fs.names(spark, path) if not re.search("[.=]|^_", n)]
    if odd:
        raise ValueError(f"{path}: names without the suffix of a format: {odd[:5]}")


def read_files(
    spark: SparkSession,
    path: str,
    data_format: str,
    schema: T.StructType | str | None = None,
    **options: str,
) -> DataFrame:
    """All files of a format in a folder. CSV takes a header and infers types by default."""
    _require_suffixes(spark, path)
    defaults = CSV_DEFAULTS if data_format == "csv" else {}
    reader = spark.read.format(data_format)
    if schema is not None:
        defaults = {k: v for k, v in defaults.items() if k != "inferSchema"}
        reader = reader.schema(schema)
    return reader.options(**{**defaults, **options}).load(files_of(path, data_format))


def infer_schema(
    spark: SparkSession, path: str, data_format: str = "json", **options: str
) -> T.StructType:
    """Schema by reading the files; ``samplingRatio`` trades completeness for a cheaper pass."""
    inferred = read_files(spark, path, data_format, **options).schema
    return T.StructType([f for f in inferred.fields if f.name != CORRUPT])


def read_stream(
    spark: SparkSession,
    path: str,
    data_format: str,
    schema: T.StructType | str,
    max_files_per_trigger: int | None = 1,
    arrival: bool = False,
    **options: str,
) -> DataFrame:
    """All files below a folder as a stream, oldest first, whatever their names.

    ``arrival`` adds the time each row's file was written and what arrived with it: the file, or the
    landed batch whose parts are written in parallel. See :func:`arrived_together`.
    """
    merged = {"header": "true", **options} if data_format == "csv" else dict(options)
    if max_files_per_trigger:
        merged["maxFilesPerTrigger"] = str(max_files_per_trigger)
    reader = spark.readStream.schema(schema).format(data_format).options(**merged)
    stream = reader.option("recursiveFileLookup", "true").load(path)
    if not arrival:
        return stream
    file = F.col("_metadata.file_path")
    return stream.select(
        "*",
        F.col("_metadata.file_modification_time").alias(ARRIVED),
        F.regexp_replace(file, r"(/\d{4}-\d{2}-\d{2}_\d+\.json)/[^/]+$", "$1").alias(ARRIVED_FILE),
    )


def arrived_together(rows: DataFrame) -> DataFrame:
    """Rows with one time for all parts of a landed batch: that of its last part.

    Names break ties, batch numbers by their value. The times, a row for each file or batch, are sent to the rows: a
    batch of any size has one name, so a shuffle on names would bring it into one task.
    """
    times = rows.groupBy(ARRIVED_FILE).agg(F.max(ARRIVED).alias("__last"))
    number = F.regexp_extract(ARRIVED_FILE, r"_(\d+)\.json$", 1)
    name = F.concat(F.regexp_replace(ARRIVED_FILE, r"_\d+\.json$", "_"), F.lpad(number, 12, "0"))
    times = times.select(F.col(ARRIVED_FILE).alias("__file"), "__last", name.alias("__name"))
    joined = rows.join(F.broadcast(times), F.col(ARRIVED_FILE) == F.col("__file"))
    return joined.withColumns({ARRIVED: F.col("__last"), ARRIVED_FILE: F.col("__name")}).drop("__last", "__file", "__name")


def read_json_checked(
    spark: SparkSession, path: str, schema: T.StructType, fail_fast: bool = False, **options: str
) -> DataFrame:
    """JSON with the text of every malformed record in ``_corrupt_record``, or an error.

    Records are objects, alone on a line or in a one-line array; anything else is malformed.
    """
    if fail_fast:
        return read_files(spark, path, "json", schema, mode="FAILFAST", **options)
    checked = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    rows = read_files(spark, path, "json", checked, columnNameOfCorruptRecord=CORRUPT, **options)
    # JSON scans refuse to read the corrupt column alone, so tie an empty text of a data column to it.
    nothing = F.substring(F.coalesce(F.col(schema.names[0]).cast("string"), F.lit("")), 1, 0)
    return rows.withColumn(CORRUPT, F.concat(F.col(CORRUPT), nothing))


def split_corrupt(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good records, and the texts of the rejected ones."""
    good = checked.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return good, checked.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)
