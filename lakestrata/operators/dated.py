"""Rows of one day: count, remove."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from lakestrata.functions.columns import day_filters


def rows_on_day(df: DataFrame, date_field: str, day: str | dt.date) -> DataFrame:
    return df.filter(day_filters(df.schema[date_field], day)[0])


def without_day(df: DataFrame, date_field: str, day: str | dt.date) -> DataFrame:
    """All rows but those of the day; rows without a date stay."""
    return df.filter(day_filters(df.schema[date_field], day)[1])
