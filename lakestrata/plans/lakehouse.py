"""The layers put together: land, bronze, silver, gold."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from typing import Any

from pyspark import StorageLevel
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lakestrata.functions.columns import day_filters, iso_day
from lakestrata.layout import BRONZE, GOLD, RAW, SILVER, Layout
from lakestrata.operators.affected import refresh_groups
from lakestrata.operators.dated import rows_on_day, without_day
from lakestrata.operators.latest import latest_per_key
from lakestrata.operators.merge import LAST_BATCH_WINS, align
from lakestrata.operators.partial import combined, refresh_parts
from lakestrata.operators.shape import id_range, ingest_stamp
from lakestrata.operators.upsert import merge_into, upsert
from lakestrata.plans.config import BronzeEntry, GoldEntry, SilverEntry
from lakestrata.plans.sql import execute_query, run_sql_file, target_name
from lakestrata.sources.files import (
    CORRUPT,
    infer_schema,
    read_files,
    read_json_checked,
    split_corrupt,
)
from lakestrata.sources.json_array import read_json_array
from lakestrata.sources.landing import TEXT_TIMES, land_batch
from lakestrata.sources.tables import BUCKET, Table
from lakestrata.streaming.cdc import start_cdc

TABLE = "table"
SNAPSHOT = "snapshot_date"


class Lakehouse:
    def __init__(self, spark: SparkSession, layout: Layout | str):
        self.spark = spark
        self.layout = Layout(layout) if isinstance(layout, str) else layout

    # loading and saving

    def table(self, layer: str, schema: str, name: str) -> Table:
        return Table(self.spark, self.layout.path(layer, schema, name))

    def load(
        self, layer: str, schema: str, table: str, data_format: str = TABLE, **options: Any
    ) -> DataFrame:
        """A layer table, or all files of a format (json, csv, parquet, orc, text) in its folder.

        ``columns`` gives raw files a schema, as DDL text or a type, and spares the pass to infer it.
        """
        path = self.layout.path(layer, schema, table)
        if data_format == TABLE:
            return Table(self.spark, path).read()
        if data_format == "delta":
            return self.spark.read.format("delta").options(**options).load(path)
        return read_files(self.spark, path, data_format, options.pop("columns", None), **options)

    def save(
        self,
        df: DataFrame,
        layer: str,
        schema: str,
        table: str,
        data_format: str = TABLE,
        mode: str = "overwrite",
        **options: str,
    ) -> None:
        """Overwrite (also the schema) or append."""
        if data_format != TABLE:
            path = self.layout.path(layer, schema, table)
            times = TEXT_TIMES if data_format in ("json", "csv") else {}
            df.write.format(data_format).mode(mode).options(**{**times, **options}).save(path)
            return
        stored = self.table(layer, schema, table)
        if mode == "overwrite" or not stored.exists():
            stored.overwrite(df)
        elif mode == "append":
            stored.append(df)
        else:
            raise ValueError(f"unknown mode {mode!r}")

    def purge(self, layer: str, schema: str, table: str, keep: int = 2) -> None:
        """Delete files that only versions older than the newest ``keep`` use."""
        self.table(layer, schema, table).purge(keep)

    def execute_query(self, query: str) -> DataFrame:
        return execute_query(self.spark, query)

    def register(self, layer: str, schema: str, table: str) -> DataFrame:
        """Make a table readable by SQL as ``<schema>_<table>`` and ``<layer>_<schema>_<table>``.

        Silver and gold inputs share the short name; a query keeps the one registered before it.
        """
        df = self.load(layer, schema, table)
        name = self.layout.view(schema, table)
        df.createOrReplaceTempView(name)
        df.createOrReplaceTempView(f"{layer}_{name}")
        return df

    # raw

    def land(
        self,
        df: DataFrame,
        schema: str,
        table: str,
        as_of: str | None = None,
        id_field: str | None = None,
        initial_id=None,
        final_id=None,
        stamp_field: str = "updated_at",
        **options: Any,
    ) -> str:
        """Extract an id range (or everything), stamp it and write the day's next raw batch."""
        as_of = as_of or dt.datetime.now().isoformat()
        rows = id_range(df, id_field, initial_id, final_id) if id_field else df
        stamped = ingest_stamp(rows, as_of, stamp_field)
        return land_batch(stamped, self.layout.path(RAW, schema, table), as_of[:10], **options)

    # bronze

    def rejects(self, schema: str, table: str) -> Table:
        """Texts of the malformed records that a bronze table was not given."""
        return self.table(BRONZE, schema, f"{table}_rejected")

    def bronze_full_load(
        self,
        schema: str,
        load: str,
        save: str | None = None,
        data_format: str = "json",
        columns: str | StructType | None = None,
        dedupe: bool = False,
        keys: str | list[str] | None = None,
        order_by: str | list[str] | None = None,
        fail_fast: bool = False,
        long_arrays: bool = False,
        **options: Any,
    ) -> None:
        """Replace the bronze table by all raw files, as they are or without repeated rows.

        ``dedupe`` keeps the latest row of each of ``keys``, or without keys one of equal rows. The texts
        of malformed JSON go to :meth:`rejects`; ``fail_fast`` makes them an error. ``long_arrays`` reads files that are
        one array each, on one line or many, by several tasks a file; it needs ``columns``.
        """
        save = save or load
        if data_format == "json":
            path = self.layout.path(RAW, schema, load)
            if columns is None and long_arrays:
                raise ValueError("long arrays are read with given columns")
            if columns is None:
                columns = infer_schema(self.spark, path, "json", **options)
            kind = StructType.fromDDL(columns) if isinstance(columns, str) else columns
            read = read_json_array if long_arrays else read_json_checked
            df = read(self.spark, path, kind, fail_fast, **options)
            if fail_fast:
                df = df.drop(CORRUPT) if long_arrays else df
            else:
                df, bad = split_corrupt(df)
                if self.rejects(schema, save).exists() or not bad.isEmpty():
                    self.rejects(schema, save).overwrite(bad.select(F.col(CORRUPT).alias("record")))
        else:
            df = self.load(RAW, schema, load, data_format, columns=columns, **options)
        if dedupe:
            df = latest_per_key(df, keys, order_by or []) if keys else df.distinct()
        self.table(BRONZE, schema, save).overwrite(df)

    def upsert(self, batch: DataFrame, schema: str, table: str, keys, order_by, **options) -> None:
        """Batch form of the change-data upsert into bronze."""
        upsert(self.table(BRONZE, schema, table), batch, keys, order_by, **options)

    def start_bronze_cdc(
        self,
        schema: str,
        load: str,
        keys,
        order_by,
        save: str | None = None,
        policy: str = LAST_BATCH_WINS,
        columns: str | StructType | None = None,
        **options: Any,
    ) -> StreamingQuery:
        """Start the upsert of all new raw files; without ``columns`` the first run infers them."""
        save = save or load
        return start_cdc(
            self.spark,
            self.layout.path(RAW, schema, load),
            self.table(BRONZE, schema, save),
            self.layout.checkpoint(schema, save),
            keys,
            order_by,
            columns,
            policy=policy,
            rejects=self.rejects(schema, save),
            **options,
        )

    def bronze_cdc(self, *args: Any, **kwargs: Any) -> None:
        """Upsert all new raw files and wait for the end; an error in the stream is raised here."""
        self.start_bronze_cdc(*args, **kwargs).awaitTermination()

    # silver

    def to_silver(
        self,
        sql_path: str,
        schema: str,
        load: str,
        merge_condition: str | bool | None = None,
        save: str | None = None,
        buckets: int | None = None,
        incremental: bool = False,
        persist: bool = False,
        args: Mapping[str, Any] | None = None,
    ) -> None:
        """Transform a bronze table by a SQL file, then merge it, or rebuild data and schema.

        A merge runs the transform several times, mostly for its keys alone: cheaper than storing
        the rows of a projection, but ``persist`` them when the SQL joins or aggregates.
        ``incremental`` reads only the buckets of bronze that were written since silver last read it, by the
        version that silver remembers; right for SQL that makes each row from one row.
        """
        target = self.table(SILVER, schema, save or target_name(sql_path))
        df = self.register(BRONZE, schema, load)
        if incremental and merge_condition:
            source = self.table(BRONZE, schema, load)
            # what is read and what is marked as read are one version, whatever is written meanwhile
            meta = source.meta()
            name, version = f"source:{source.path}", meta["version"]
            seen = (target.meta() or {}).get("marks", {}).get(name)
            if seen == version:
                return
            changed = None if seen is None else source.changed_since(seen, meta)
            df = source.read(changed, meta=meta)
            target.mark = (name, version)
        rows = run_sql_file(self.spark, sql_path, {self.layout.view(schema, load): df}, args)
        if not merge_condition:
            target.overwrite(rows)
            return
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK) if persist else rows
        try:
            merge_into(target, rows, condition=merge_condition, buckets=buckets)
        finally:
            if persist:
                rows.unpersist()

    def to_silver_groups(
        self,
        sql_path: str,
        schema: str,
        load: str,
        group_by: Mapping[str, str],
        save: str | None = None,
        buckets: int | None = None,
        args: Mapping[str, Any] | None = None,
    ) -> None:
        """Keep a silver table up to date with SQL that groups, joins or ranks within groups of a bronze table.

        ``group_by`` gives for key columns of silver the bronze expression that each is. Only groups with rows that
        changed since the last run are worked out again (:func:`refresh_groups`). Other tables that the SQL reads
        are read as they are, and their changes alone set nothing in motion.
        """
        view = self.layout.view(schema, load)

        def transform(rows: DataFrame) -> DataFrame:
            return run_sql_file(self.spark, sql_path, {view: rows}, args)

        target = self.table(SILVER, schema, save or target_name(sql_path))
        refresh_groups(target, self.table(BRONZE, schema, load), group_by, transform, buckets)

    # gold

    def to_gold(
        self,
        sql_path: str,
        schema: str,
        load: str,
        date: str | dt.date,
        new_table: bool = False,
        save: str | None = None,
        date_field: str | None = None,
        as_of: str | None = None,
        args: Mapping[str, Any] | None = None,
    ) -> None:
        """Aggregate a silver table by a SQL file and store it as the snapshot of one day.

        A rerun replaces that day in one step and no other. ``as_of`` stamps ``date_field`` with a
        fixed time of that day instead of the time the SQL gives.
        """
        self.register(SILVER, schema, load)
        rows = run_sql_file(self.spark, sql_path, args=args)
        if as_of is not None:
            if iso_day(as_of[:10]) != iso_day(date):
                raise ValueError(f"as_of {as_of} is not on {date}")
            rows = rows.withColumn(date_field, F.lit(as_of).cast(rows.schema[date_field].dataType))
        target = self.table(GOLD, schema, save or target_name(sql_path))
        replace_snapshot(target, rows, date, new_table)

    def to_gold_parts(
        self,
        schema: str,
        load: str,
        save: str,
        group_by: Mapping[str, str],
        measures: Mapping[str, tuple[str, str]],
        date: str | dt.date,
    ) -> None:
        """Store an aggregate of a silver table as the snapshot of one day, from parts kept for each silver bucket.

        Only buckets that changed since the last run are read (:func:`refresh_parts`); the parts lie in ``<save>_parts``.
        """
        parts = self.table(GOLD, schema, f"{save}_parts")
        refresh_parts(parts, self.table(SILVER, schema, load), group_by, measures)
        replace_snapshot(self.table(GOLD, schema, save), combined(parts, group_by, measures), date)

    def delete_day(self, schema: str, table: str, date_field: str, day: str | dt.date) -> int:
        """Remove a gold table's rows of one day and give their number."""
        return delete_day(self.table(GOLD, schema, table), date_field, day)

    # workflows

    def run_bronze(self, entries: list[BronzeEntry]) -> None:
        """Full loads in order; change-data streams side by side. Every entry is run, and every stream
        awaited, before the first error is raised."""
        queries, errors = [], []
        for e in entries:
            try:
                if query := self._bronze_entry(e):
                    queries.append(query)
            except Exception as error:  # noqa: BLE001  raised below, once all streams have ended
                errors.append(error)
        for query in queries:
            try:
                query.awaitTermination()
            except StreamingQueryException as error:
                errors.append(error)
        if errors:
            raise errors[0]

    def _bronze_entry(self, e: BronzeEntry) -> StreamingQuery | None:
        names = (e.schema, e.tablename_load)
        if e.full_load:
            self.bronze_full_load(
                *names,
                e.tablename_save,
                e.data_format,
                e.columns,
                e.dedupe,
                e.id_field,
                e.timestamp_field,
                e.fail_fast,
            )
            return None
        return self.start_bronze_cdc(
            *names,
            e.id_field,
            e.timestamp_field,
            e.tablename_save,
            e.policy,
            columns=e.columns,
            data_format=e.data_format,
            tie_breakers=e.tie_breakers,
            max_files_per_trigger=e.max_files_per_trigger,
            buckets=e.buckets,
            fail_fast=e.fail_fast,
        )

    def run_silver(self, entries: list[SilverEntry], sql_dir: str) -> None:
        for e in entries:
            self.to_silver(
                f"{sql_dir}/{e.tablename_save}.sql",
                e.schema,
                e.tablename_load,
                e.merge_condition,
                buckets=e.buckets,
                incremental=e.incremental,
                persist=e.persist,
            )

    def run_gold(self, entries: list[GoldEntry], sql_dir: str) -> None:
        for e in entries:
            self.to_gold(
                f"{sql_dir}/{e.tablename_save}.sql",
                e.schema,
                e.tablename_load,
                e.date,
                e.new_table,
                date_field=e.date_field,
                as_of=e.as_of,
            )


def replace_snapshot(
    table: Table, rows: DataFrame, day: str | dt.date, new_table: bool = False
) -> None:
    """Store rows as one day's partition, replacing what the day held (also by nothing)."""
    snapshot = rows.withColumn(SNAPSHOT, F.lit(dt.date.fromisoformat(iso_day(day))))
    if new_table or not table.exists():
        table.overwrite(snapshot, partition_by=SNAPSHOT)
    else:
        table.replace(align(snapshot, table.schema), [f"{SNAPSHOT}={iso_day(day)}"])


def append_snapshot(table: Table, rows: DataFrame, day: str | dt.date) -> None:
    """Add rows to one day's partition, next to what it holds."""
    snapshot = rows.withColumn(SNAPSHOT, F.lit(dt.date.fromisoformat(iso_day(day))))
    if table.exists():
        table.append(align(snapshot, table.schema))
    else:
        table.overwrite(snapshot, partition_by=SNAPSHOT)


def delete_day(table: Table, date_field: str, day: str | dt.date) -> int:
    """Remove the rows of one day, rewriting only partitions, or in other tables files, that hold some, and count them."""
    meta, df = table.meta(), table.read()
    part = meta["partition_by"]
    if part not in (SNAPSHOT, BUCKET):
        files = table.files_with(day_filters(table.schema[date_field], day)[0])
        if files:
            kept = without_day(table.read_files([row.file for row in files]), date_field, day)
            table.replace_files(files, kept)
        return sum(row.n for row in files)
    if part == BUCKET:
        df = table.read(with_bucket=True)
    counts = rows_on_day(df, date_field, day).groupBy(part).count().collect()
    touched = [f"{part}={row[0]}" for row in counts]
    if touched:
        table.replace(without_day(table.read(touched), date_field, day), touched)
    return sum(row["count"] for row in counts)
