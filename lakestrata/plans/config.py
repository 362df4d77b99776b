"""Workflow files: a JSON list of entries per layer, run in list order."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from typing import TypeVar

from pyspark.sql import SparkSession

from lakestrata.operators.merge import LAST_BATCH_WINS
from lakestrata.plans.sql import read_sql


@dataclass(frozen=True)
class BronzeEntry:
    schema: str
    tablename_load: str
    tablename_save: str
    full_load: bool = False
    id_field: str | list[str] | None = None
    timestamp_field: str | None = None
    data_format: str = "json"
    columns: str | None = None
    policy: str = LAST_BATCH_WINS
    tie_breakers: str | list[str] | None = None
    max_files_per_trigger: int | None = None
    buckets: int | None = None
    dedupe: bool = False
    fail_fast: bool = False


@dataclass(frozen=True)
class SilverEntry:
    schema: str
    tablename_load: str
    tablename_save: str
    merge_condition: str | bool | None = None
    buckets: int | None = None
    incremental: bool = False
    persist: bool = False


@dataclass(frozen=True)
class GoldEntry:
    schema: str
    tablename_load: str
    tablename_save: str
    date: str
    date_field: str | None = None
    new_table: bool = False
    as_of: str | None = None


Entry = TypeVar("Entry", BronzeEntry, SilverEntry, GoldEntry)


def parse(kind: type[Entry], entries: list[dict]) -> list[Entry]:
    known = {f.name for f in fields(kind)}
    for entry in entries:
        unknown = set(entry) - known
        if unknown:
            raise ValueError(f"unknown keys in {kind.__name__}: {sorted(unknown)}")
    return [kind(**entry) for entry in entries]


def load(spark: SparkSession, path: str, kind: type[Entry]) -> list[Entry]:
    return parse(kind, json.loads(read_sql(spark, path)))
