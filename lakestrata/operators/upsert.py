"""Merges into stored tables that rewrite only the buckets they touch."""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lakestrata.functions.columns import as_list, quoted
from lakestrata.functions.plans import comes_from_shuffle_on, dealt_by_rows, estimated_bytes, rows_read
from lakestrata.operators.latest import latest_per_key
from lakestrata.operators.merge import (
    LAST_BATCH_WINS,
    NEWEST_WINS,
    align,
    check_single_match,
    kept_rows,
    merge_all,
    merge_unique,
    read_condition,
    repeated_keys,
    spelled_as,
    without_stale,
)
from lakestrata.sources.tables import BUCKET, Table

# A bound on the measured key bytes of a source whose keys are sent to every executor.
SMALL_SOURCE = 32 * 1024 * 1024
# Writes that leave kept rows in place before the touched buckets are rebalanced again.
COMPACT_EVERY = 16


def merge_into(
    table: Table,
    source: DataFrame,
    on: str | list[str] | None = None,
    condition: str | None = None,
    newest_by: str | list[str] | None = None,
    tie_breakers: str | list[str] | None = None,
    source_unique: bool = False,
    by_key: bool = False,
    buckets: int | None = None,
    small_source: int = SMALL_SOURCE,
    rows: int = 0,
) -> None:
    """Update all matched rows, insert the others, and create the table on the first run.

    A table is kept bucketed by the columns a merge equates (into ``buckets``, or as many as its size
    asks for), and only the buckets present in the source are read, joined and rewritten, also where
    the condition says more. While the table holds each key once, a source of few keys costs no
    shuffle of the target. A condition without such columns rewrites the table. ``rows`` tells how many
    the source is made from, if its plan cannot: tasks are made by their number.
    """
    if (on is None) == (condition is None):
        raise ValueError("give either on or condition")
    rows = max(rows, rows_read(source))
    with dealt_by_rows(source.sparkSession, rows):
        _merge(table, source, on, condition, newest_by, tie_breakers, source_unique, by_key, buckets, small_source, rows)


def _merge(
    table, source, on, condition, newest_by, tie_breakers, source_unique, by_key, buckets, small_source, rows
) -> None:
    meta = table.meta()
    stored = source.columns if meta is None else table.schema.names
    found = read_condition(condition) if condition else None
    keys = spelled_as(as_list(on) or found.keys, stored)
    if meta and sorted(meta["bucket_by"]) == sorted(keys):
        keys = meta["bucket_by"]  # in whatever order a condition names them
    if meta is None:
        unique = bool(keys) and (source_unique or check_single_match(source.limit(0), source, keys))
        table.overwrite(source, keys, buckets, unique=unique, by_key=by_key, rows=rows)
        return

    source, newest, ties = align(source, table.schema), as_list(newest_by), as_list(tie_breakers)
    if not keys:
        with _kept() as keep:
            merged = merge_all(table.read(), source, None, condition, newest, ties, keep=keep)
            table.overwrite(merged, **_layout(meta))
        return
    if found and not found.plain:
        _merge_on_more(table, source, keys, condition, newest, ties, buckets)
        return
    wanted = buckets or (table.buckets_wanted() if meta["bucket_by"] == keys else None)
    if meta["bucket_by"] != keys or meta["buckets"] != wanted:
        _merge_and_bucket(table, source, keys, newest, ties, source_unique, wanted)
        return

    sizes = _bucket_sizes(table.bucketed(source, meta), keys, newest + ties, source_unique)
    touched = [f"{BUCKET}={row[BUCKET]}" for row in sizes]
    if not touched:
        return
    target = table.read(touched, with_bucket=True)
    if any(row["copies"] > 1 for row in sizes):
        check_single_match(target, source, keys)
        source_unique = False
    else:
        source_unique = True
    if not (meta["unique"] and source_unique):
        merged = merge_all(target.drop(BUCKET), source, keys, None, newest, ties, check=False)
        table.replace(merged, touched, unique=False)
        return
    if sum(row["bytes"] for row in sizes) > small_source:
        if newest:
            merged = merge_unique(target.drop(BUCKET), source, keys, newest, ties)
            table.replace(merged, touched, by_key=True)
        else:
            _replace(table, kept_rows(target, source, keys), source, touched, table.shuffles_fit())
        return
    if newest:
        source = without_stale(target, source, keys, newest, ties, small=True)
    kept, thin = kept_rows(target, source, keys, small=True), meta["thin"] < COMPACT_EVERY
    _replace(table, kept, source, touched, in_place=thin, thin=thin)


@contextmanager
def _kept():
    """Persists what it is given until the write is over."""
    held = []

    def keep(df: DataFrame) -> DataFrame:
        held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return held[-1]

    try:
        yield keep
    finally:
        for df in held:
            df.unpersist()


def _merge_on_more(table, source, keys, condition, newest, ties, buckets) -> None:
    """Merge on equal keys and something else: the buckets of the source's keys, joined once.

    A source row that fails the rest is inserted beside the row of its key, so keys may repeat.
    """
    meta = table.meta()
    wanted = buckets or (table.buckets_wanted() if meta["bucket_by"] == keys else table.buckets_for(meta["bytes"]))
    if meta["bucket_by"] != keys or meta["buckets"] != wanted:
        table.overwrite(table.read(), keys, wanted, unique=False)
    spread = table.bucketed(source).select(BUCKET).distinct().collect()  # at most a row for each bucket
    touched = [f"{BUCKET}={row[BUCKET]}" for row in spread]
    if not touched:
        return
    with _kept() as keep:
        merged = merge_all(table.read(touched), source, None, condition, newest, ties, keep=keep)
        table.replace(merged, touched, unique=False)


def _replace(table, kept, added, touched, in_place, thin=False) -> None:
    if in_place:
        table.replace_kept(kept, added, touched, thin)
    else:
        table.replace(kept.drop(BUCKET).unionByName(added), touched)


def _merge_and_bucket(table, source, keys, newest, ties, source_unique, buckets) -> None:
    """Merge into a table of another layout, and leave it bucketed for the merges to come."""
    target, meta = table.read(), table.meta()
    source_unique = source_unique or check_single_match(target, source, keys)
    stored_unique = meta["unique"] and meta["bucket_by"] == keys
    unique = source_unique and (stored_unique or repeated_keys(target, keys).isEmpty())
    if unique:
        merged = merge_unique(target, source, keys, newest, ties)
    else:
        merged = merge_all(target, source, keys, None, newest, ties, check=False)
    number = buckets or table.buckets_for(max(meta["bytes"], estimated_bytes(source)))
    table.overwrite(merged, keys, number, unique=unique)


def _layout(meta: dict) -> dict:
    if meta["bucket_by"]:
        return {"bucket_by": meta["bucket_by"], "buckets": meta["buckets"]}
    return {"partition_by": meta["partition_by"]}


def _bucket_sizes(
    rows: DataFrame, keys: list[str], more: list[str], unique: bool
) -> list[Row]:
    """Buckets a source touches, at most one row for each, with the bytes of some columns and, unless
    keys are known to be unique, the greatest number of rows of one whole key."""
    text = [F.octet_length(quoted(c).cast("string")) for c in keys + more]
    width = reduce(lambda a, b: a + b, [F.coalesce(t, F.lit(0)) for t in text])
    size = F.sum((width + 16 * (len(text) + 1)).cast("bigint")).alias("bytes")
    if unique:
        return rows.groupBy(BUCKET).agg(size, F.lit(1).alias("copies")).collect()
    whole = reduce(lambda a, b: a & b, [quoted(k).isNotNull() for k in keys])
    per_key = rows.groupBy(BUCKET, *[quoted(k) for k in keys]).agg(
        size, F.count(F.when(whole, 1)).alias("copies")
    )
    summed = [F.sum("bytes").alias("bytes"), F.max("copies").alias("copies")]
    return per_key.groupBy(BUCKET).agg(*summed).collect()


def upsert(
    table: Table,
    batch: DataFrame,
    keys: str | list[str],
    order_by: str | list[str],
    policy: str = LAST_BATCH_WINS,
    tie_breakers: str | list[str] | None = None,
    arrival: str | list[str] | None = None,
    buckets: int | None = None,
    rows: int = 0,
) -> None:
    """Change-data upsert: the batch's latest row per key, merged into the table.

    ``last_batch_wins`` overwrites a stored row even with an older one; ``newest_wins`` compares
    ``order_by``. ``arrival`` names columns (dropped afterwards) that tell when a row arrived: under
    ``last_batch_wins`` they rank before ``order_by``, so that many arrivals merged at once end up
    as if merged one by one. ``rows`` tells the number of rows of a batch whose plan cannot.
    """
    if policy not in (LAST_BATCH_WINS, NEWEST_WINS):
        raise ValueError(f"unknown policy {policy!r}")
    keys, order_by, arrival = as_list(keys), as_list(order_by), as_list(arrival)
    newest = policy == NEWEST_WINS
    data = batch.drop(*arrival) if newest else batch
    ranked = order_by if newest else arrival + order_by
    latest = latest_per_key(data, keys, ranked, tie_breakers).drop(*arrival)
    rows = max(rows, rows_read(batch))
    with dealt_by_rows(batch.sparkSession, rows):
        _upsert(table, latest, keys, order_by if newest else None, tie_breakers, buckets, rows)


def _upsert(table, latest, keys, newest_by, tie_breakers, buckets, rows) -> None:
    options = {
        "on": keys,
        "newest_by": newest_by,
        "tie_breakers": tie_breakers,
        "source_unique": True,
        "buckets": buckets,
    }
    if not table.exists():
        merge_into(table, latest, by_key=comes_from_shuffle_on(latest, keys), rows=rows, **options)
        return
    # A merge reads its source several times: do not parse and shuffle the batch each time.
    latest = latest.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        merge_into(table, latest, **options)
    finally:
        latest.unpersist()
