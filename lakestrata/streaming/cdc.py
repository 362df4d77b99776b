"""Run-to-completion streams that fold raw files into tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lakestrata.functions.columns import as_list, fresh
from lakestrata.functions.plans import rows_streamed
from lakestrata.operators.latest import latest_per_key_agg
from lakestrata.operators.merge import LAST_BATCH_WINS
from lakestrata.operators.upsert import merge_into, upsert
from lakestrata.sources import fs
from lakestrata.sources.files import (
    ARRIVED,
    ARRIVED_FILE,
    CORRUPT,
    CSV_DEFAULTS,
    arrived_together,
    infer_schema,
    read_stream,
)
from lakestrata.sources.tables import Table


def _files_below(spark: SparkSession, raw_path: str, data_format: str, **options: str) -> DataFrame:
    """All files below a folder, whatever their names, as the stream reads them."""
    defaults = CSV_DEFAULTS if data_format == "csv" else {}
    reader = spark.read.format(data_format).options(**{**defaults, **options, "recursiveFileLookup": "true"})
    return reader.load(raw_path)


def _schema_of(rows: DataFrame) -> T.StructType:
    return T.StructType([f for f in rows.schema.fields if f.name != CORRUPT])


#: Files this much older than a run's start are taken as new by the next run, whatever clocks say.
SLACK = dt.timedelta(hours=1)


def stream_schema(
    spark: SparkSession, raw_path: str, data_format: str, table: Table, seen: str | None = None, **options: str
) -> T.StructType:
    """The stored table's schema with what the files have that came since the last run; at first that of all files.

    Only files not looked at before are read for it. What they add is added to the table (:meth:`Table.evolve`). ``seen`` is
    a folder for the times of runs; without one, or for formats that infer nothing, the schema stays as it is.
    """
    now = dt.datetime.now(dt.UTC)
    if not table.exists():
        schema = infer_schema(spark, raw_path, data_format, **options)
    elif seen is None:
        return table.schema
    else:
        runs = [n for n in fs.names(spark, seen) if n.isdigit()]
        since = {}
        if runs:
            last = dt.datetime.fromtimestamp(int(max(runs, key=int)) / 1000, dt.UTC) - SLACK
            since = {"modifiedAfter": last.strftime("%Y-%m-%dT%H:%M:%S"), "timeZone": "UTC"}
        listed = spark.read.format("binaryFile").options(recursiveFileLookup="true", **since).load(raw_path)
        if not listed.select("path").isEmpty():
            table.evolve(_schema_of(_files_below(spark, raw_path, data_format, **{**options, **since})))
        schema = table.schema
    if seen is not None:
        fs.claim(spark, f"{seen}/{int(now.timestamp() * 1000)}")
    return schema


def start_cdc(
    spark: SparkSession,
    raw_path: str,
    table: Table,
    checkpoint: str,
    keys: str | list[str],
    order_by: str | list[str],
    schema: T.StructType | str | None = None,
    data_format: str = "json",
    policy: str = LAST_BATCH_WINS,
    tie_breakers: str | list[str] | None = None,
    max_files_per_trigger: int | None = None,
    buckets: int | None = None,
    rejects: Table | None = None,
    fail_fast: bool = False,
    **options: str,
) -> StreamingQuery:
    """Upsert all files not yet processed, then stop (``availableNow``).

    By default one merge takes all new files, as each merge rewrites the buckets it touches. Rows carry
    the arrival of their file or landed batch, so under ``last_batch_wins`` the outcome is that of
    merging these one by one, oldest first. The table remembers the last batch of each stream, so a
    batch replayed after a failure is not merged twice. Await the query to see its errors.

    Without a ``schema`` columns and nested fields that new files bring are added to the table, NULL in older rows.

    Malformed JSON never reaches the table: with ``fail_fast`` it ends the stream, otherwise its text goes
    to ``rejects`` with its file and batch, or is left out if there is no such table.
    """
    if schema is None:
        schema = stream_schema(spark, raw_path, data_format, table, f"{checkpoint}_runs", **options)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    corrupt = None
    if data_format == "json" and fail_fast:
        options["mode"] = "FAILFAST"
    elif data_format == "json":
        corrupt = fresh("_corrupt_record", schema.names)
        schema = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
        options["columnNameOfCorruptRecord"] = corrupt
    stream = read_stream(
        spark, raw_path, data_format, schema, max_files_per_trigger, arrival=True, **options
    )

    def apply(batch: DataFrame, batch_id: int) -> None:
        rows = rows_streamed(batch)
        if corrupt and rejects:
            _reject(batch, corrupt, _marked(batch, rejects, batch_id), batch_id)
        if corrupt:
            batch = batch.filter(F.col(corrupt).isNull()).drop(corrupt)
        target = _marked(batch, table, batch_id)
        if target.applied():
            return
        upsert(
            target,
            arrived_together(batch) if policy == LAST_BATCH_WINS else batch,
            keys,
            order_by,
            policy,
            tie_breakers,
            arrival=[ARRIVED, ARRIVED_FILE],
            buckets=buckets,
            rows=rows,
        )

    return _run(stream, apply, checkpoint)


def _reject(batch: DataFrame, corrupt: str, table: Table, batch_id: int) -> None:
    """Store the texts of a batch's malformed records."""
    rows = batch.filter(F.col(corrupt).isNotNull()).select(
        F.col(corrupt).alias("record"),
        F.col(ARRIVED_FILE).alias("file"),
        F.lit(batch_id).cast("bigint").alias("batch"),
    )
    if table.applied() or rows.isEmpty():
        return
    if table.exists():
        table.append(rows)
    else:
        table.overwrite(rows)


def start_latest(
    stream: DataFrame,
    table: Table,
    checkpoint: str,
    keys: str | list[str],
    order_by: str | list[str],
    tie_breakers: str | list[str] | None = None,
    buckets: int | None = None,
) -> StreamingQuery:
    """Latest row per key as streaming state (one row per key), changed keys merged to a table."""
    keys = as_list(keys)

    def apply(changed: DataFrame, batch_id: int) -> None:
        target = _marked(changed, table, batch_id)
        if not target.applied():
            merge_into(target, changed, on=keys, source_unique=True, buckets=buckets)

    return _run(latest_per_key_agg(stream, keys, order_by, tie_breakers), apply, checkpoint, "update")


def _marked(batch: DataFrame, table: Table, batch_id: int) -> Table:
    """The table seen from the batch's session, marked with the stream's lasting id."""
    spark = batch.sparkSession
    stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    return Table(spark, table.path, (stream, batch_id) if stream else None)


def _run(stream: DataFrame, apply, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(apply)
        .trigger(availableNow=True)
        .start()
    )
