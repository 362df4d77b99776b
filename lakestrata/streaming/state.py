"""Latest row per key over a stream, with a state that holds ages alone and forgets them."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lakestrata.functions.columns import as_list, quoted, row_digest
from lakestrata.operators.merge import NEWEST_WINS
from lakestrata.operators.upsert import upsert
from lakestrata.sources.tables import Table
from lakestrata.streaming.cdc import _marked, _run

IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def _plain(name: str, data_type: T.DataType) -> Column:
    """A column in a type whose values Python orders as Spark does."""
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(quoted(name))
    return quoted(name).cast("string") if isinstance(data_type, T.TimestampNTZType) else quoted(name)


def _age(values: tuple[Any, ...]) -> tuple:
    """Ages in Spark's order: NULL the oldest, NaN the youngest."""
    return tuple((0, 0) if v is None else (2, 0) if v != v else (1, v) for v in values)


def _newest(rows: DataFrame, keys: int, ages: int) -> DataFrame:
    """One row of each key per Arrow batch, packed: a hot key sends few rows to the task that holds its state.

    The first columns are the keys, then come the ages, then the row. What is packed keeps its exact values.
    """
    names = [f"k{i}" for i in range(keys)]
    kinds = [f.dataType.simpleString() for f in rows.schema.fields[:keys]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[: keys + ages]]
            best: dict[tuple, tuple] = {}
            for i, values in enumerate(zip(*columns, strict=True)):
                key, age = values[:keys], _age(values[keys:])
                if key not in best or age > best[key][0]:
                    best[key] = (age, i)
            chosen = batch.take(pa.array([i for _, i in best.values()], pa.int64()))
            packed = [pickle.dumps(r) for r in zip(*[c.to_pylist() for c in chosen.columns[keys + ages :]], strict=True)]
            age = [pickle.dumps(a) for a, _ in best.values()]
            arrays = [*chosen.columns[:keys], pa.array(age, pa.binary()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "age", "row"])

    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    return rows.mapInArrow(run, f"{schema}, age binary, row binary")


def _younger(ttl_ms: int | None):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = None
        for frame in frames:
            for age, row in zip(frame["age"], frame["row"], strict=True):
                found = (pickle.loads(age), row)
                best = found if best is None or found[0] > best[0] else best
        held = pickle.loads(state.get[0]) if state.exists else None
        if best is not None and (held is None or best[0] > held):
            state.update((pickle.dumps(best[0]),))
            yield pd.DataFrame({"row": [best[1]]})
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)

    return run


def latest_with_state(
    stream: DataFrame,
    keys: str | list[str],
    order_by: str | list[str],
    tie_breakers: str | list[str] | None = None,
    ttl: str | None = None,
) -> DataFrame:
    """Rows of a stream that are newer than all of their key before, the newest of each trigger.

    The state has a row for each key: what it is ordered by and a digest, never the row itself. With a ``ttl``
    (an interval such as ``7 days``) a key that had no row for so long is forgotten, and its next row passes
    whatever its age: merge the result by age (:func:`start_latest_with_state`).
    """
    keys, order = as_list(keys), as_list(order_by) + as_list(tie_breakers)
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    ages = [_plain(n, kinds[n]) for n in order] + [row_digest(stream.schema)]
    columns = [*[quoted(k) for k in keys], *ages, *[quoted(c) for c in stream.columns]]
    packed = _newest(stream.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]), len(keys), len(ages))
    ttl_ms = None
    if ttl is not None:
        ends = [f"unix_millis(timestamp'1970-01-01 00:00:00' {more})" for more in (f"+ INTERVAL {ttl}", "")]
        ttl_ms = stream.sparkSession.range(1).select(F.expr(f"{ends[0]} - {ends[1]}")).first()[0]
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    grouped = packed.groupBy(*[f"k{i}" for i in range(len(keys))])
    found = grouped.applyInPandasWithState(_younger(ttl_ms), "row binary", "age binary", "update", timeout)
    arrow, names = [f.type for f in to_arrow_schema(stream.schema)], stream.columns

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*map(pickle.loads, batch.column(0).to_pylist()), strict=True)) or [[]] * len(arrow)
            arrays = [pa.array(values, kind) for values, kind in zip(rows, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return found.mapInArrow(unpack, stream.schema)


def start_latest_with_state(
    stream: DataFrame,
    table: Table,
    checkpoint: str,
    keys: str | list[str],
    order_by: str | list[str],
    tie_breakers: str | list[str] | None = None,
    ttl: str | None = None,
    buckets: int | None = None,
) -> StreamingQuery:
    """Keep a table at the latest row per key of a stream, run to completion (``availableNow``).

    Stale rows are mostly dropped by the state; those of forgotten keys are compared with the stored row, so the table
    does not depend on the ``ttl``.
    """
    keys = as_list(keys)

    def apply(changed: DataFrame, batch_id: int) -> None:
        target = _marked(changed, table, batch_id)
        if not target.applied():
            upsert(target, changed, keys, order_by, NEWEST_WINS, tie_breakers, buckets=buckets)

    changed = latest_with_state(stream, keys, order_by, tie_breakers, ttl)
    # keys are forgotten by the runs that have new files; a run would else go on, without any, to wait for the next
    settings = stream.sparkSession.conf
    before = settings.get(IDLE_BATCHES)
    settings.set(IDLE_BATCHES, "false")
    try:
        return _run(changed, apply, checkpoint, "update")
    finally:
        settings.set(IDLE_BATCHES, before)
