"""Dated, numbered raw batches: ``<table>/<YYYY-MM-DD>_<NNN>.json``."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestrata.functions.columns import iso_day
from lakestrata.sources import fs

# Spark's default formats for text cut timestamps to milliseconds.
TEXT_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
CLAIMS = "_claims"
_BATCH = r"/\d{4}-\d{2}-\d{2}_(\d+)\.json"


def next_batch_number(spark: SparkSession, path: str, day: str | dt.date) -> int:
    """1 + the greatest number landed or claimed on a day (also by an unfinished batch), from names alone."""
    shape = re.compile(rf"{iso_day(day)}_(\d+)\.json")
    names = fs.names(spark, path) + fs.names(spark, f"{path}/{CLAIMS}")
    found = [shape.fullmatch(name) for name in names]
    return max((int(m.group(1)) for m in found if m), default=0) + 1


def claim_batch(spark: SparkSession, path: str, day: str | dt.date) -> str:
    """Name of the day's next batch, which no other writer is given; an empty file in ``_claims`` holds it.

    A batch that fails leaves its number unused.
    """
    number = next_batch_number(spark, path, day)
    while True:
        name = f"{iso_day(day)}_{number:03d}.json"
        if fs.claim(spark, f"{path}/{CLAIMS}/{name}"):
            return name
        number += 1


def land_batch(
    df: DataFrame, path: str, day: str | dt.date, array_lines: bool = False, **options: str
) -> str:
    """Write one batch, in parallel, as lines of JSON records or of one-record arrays; several writers may land at once."""
    target = f"{path}/{claim_batch(df.sparkSession, path, day)}"
    times = {**TEXT_TIMES, **options}
    if not array_lines:
        df.write.mode("errorifexists").options(**times).json(target)
        return target
    records = df.select(F.to_json(F.array(F.struct("*")), times).alias("value"))
    records.write.mode("errorifexists").text(target)
    return target


def batch_number(file_path: Column | str = "_metadata.file_path") -> Column:
    """Number of the batch a row was landed in."""
    path = F.col(file_path) if isinstance(file_path, str) else file_path
    return F.regexp_extract(path, _BATCH, 1).cast("int")
