"""Mutable tables over plain parquet, without a table format on the classpath.

A table is a folder of write-once version folders::

    <table>/_v=00000007/[<partition>=<value>/]part-*.parquet
    <table>/_v=00000007/_meta.json      written last: the version counts from then on

A write touches only new files, so a lost executor or driver leaves the previous version readable,
nothing is renamed (which object stores would copy), and running readers keep their files. The
newest ``_meta.json`` names the version folders that hold each partition, so a merge can rewrite the
partitions it touches and leave the rest where they are. One writer per table is assumed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestrata.functions.columns import bucket_of, fresh, nullable, quoted, union_schema
from lakestrata.functions.plans import TASK_ROWS, dealt_by_rows, estimated_bytes, rows_read
from lakestrata.sources import fs

# Bytes a bucket should hold.
BUCKET_BYTES = 512 * 1024 * 1024

BUCKET = "_bucket"
VERSION = "_v"
_META = "_meta.json"
_IN_TABLE = re.compile(rf"/{VERSION}=(\d+)/(?:([^/]+)/)?([^/]+)$")


class Table:
    """``mark`` names the stream and the number of the batch being written, so that a batch replayed
    after a failure can be told by :meth:`applied`; or what was read for the write, and its version."""

    def __init__(self, spark: SparkSession, path: str, mark: tuple | None = None):
        self.spark = spark
        self.path = path.rstrip("/")
        self.mark = mark

    def __repr__(self) -> str:
        return f"Table({self.path!r})"

    # reading

    def _folder(self, version: int) -> str:
        return f"{self.path}/{VERSION}={version:08d}"

    def _versions(self) -> list[int]:
        found = [n for n in fs.names(self.spark, self.path) if n.startswith(f"{VERSION}=")]
        return sorted((int(n.split("=")[1]) for n in found), reverse=True)

    def _load_meta(self, version: int) -> dict | None:
        path = f"{self._folder(version)}/{_META}"
        return json.loads(fs.read_text(self.spark, path)) if fs.exists(self.spark, path) else None

    def meta(self) -> dict | None:
        """Description of the newest complete version, or None for a table not written yet."""
        for version in self._versions():
            found = self._load_meta(version)
            if found:
                return found
        return None

    def at(self, version: int) -> dict | None:
        """Description of an older version, or None where it or files that it uses are gone."""
        found = self._load_meta(version)
        paths = [f"{self._folder(v)}/{p}" for p, vs in (found or {"live": {}})["live"].items() for v in vs]
        return found if all(fs.exists(self.spark, p) for p in paths) else None

    def publish_mark(self) -> None:
        """A version like the newest one that remembers the mark."""
        meta = self._need()
        marks = {**meta.get("marks", {}), **dict([self.mark] if self.mark else [])}
        self._publish({**meta, "version": max(self._versions()) + 1, "marks": marks}, meta)

    def exists(self) -> bool:
        return self.meta() is not None

    def applied(self) -> bool:
        """Whether the marked batch, or a later one of its stream, is already in the table."""
        if self.mark is None:
            return False
        stream, batch = self.mark
        return (self.meta() or {}).get("marks", {}).get(stream, -1) >= batch

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self._need()["schema"])

    def _need(self) -> dict:
        found = self.meta()
        if found is None:
            raise FileNotFoundError(f"no table at {self.path}")
        return found

    def read(
        self, partitions: list[str] | None = None, with_bucket: bool = False, meta: dict | None = None
    ) -> DataFrame:
        """The newest version, or that of a given ``meta``; of it all or some partitions (``"name=value"``)."""
        meta = meta or self._need()
        schema = T.StructType.fromJson(meta["schema"])
        names = schema.names + ([BUCKET] if with_bucket else [])
        paths = self._paths(meta, meta["live"] if partitions is None else partitions)
        if not paths:
            empty = self.spark.createDataFrame([], schema)
            return empty.withColumn(BUCKET, F.lit(0)) if with_bucket else empty
        return self._scan(meta, paths).select(*[quoted(n) for n in names])

    def _paths(self, meta: dict, partitions: Iterable[str]) -> list[str]:
        """Folders of some partitions, or where files of one were replaced, the files left of it."""
        found = []
        for partition in partitions:
            for version in meta["live"].get(partition, []):
                folder = f"{self._folder(version)}/{partition}".rstrip("/")
                gone = meta.get("without", {}).get(f"{version}/{partition}")
                if gone is None:
                    found.append(folder)
                else:
                    names = [n for n in fs.names(self.spark, folder) if n.endswith(".parquet") and n not in gone]
                    found += [f"{folder}/{n}" for n in names]
        return found

    def _scan(self, meta: dict, paths: list[str]) -> DataFrame:
        schema, part = T.StructType.fromJson(meta["schema"]), meta["partition_by"]
        fields = [f for f in schema.fields if f.name != part]
        if part:
            kind = schema[part].dataType if part in schema.names else T.IntegerType()
            fields.append(T.StructField(part, kind))
        fields.append(T.StructField(VERSION, T.StringType()))
        return self.spark.read.schema(T.StructType(fields)).option("basePath", self.path).parquet(*paths)

    def files_with(self, condition: Column) -> list[Row]:
        """Files (``file``, ``size``) that hold rows for which a condition holds, with their number ``n``."""
        meta = self._need()
        paths = self._paths(meta, meta["live"])
        if not paths:
            return []
        hits = self._scan(meta, paths).filter(condition)
        file = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")]
        found = hits.select(*file).groupBy("file", "size").agg(F.count("*").alias("n")).collect()
        return [Row(file=unquote(r.file), size=r.size, n=r.n) for r in found]

    def read_files(self, files: list[str]) -> DataFrame:
        meta = self._need()
        return self._scan(meta, files).select(*[quoted(n) for n in T.StructType.fromJson(meta["schema"]).names])

    # writing

    def overwrite(
        self,
        df: DataFrame,
        bucket_by: list[str] | None = None,
        buckets: int | None = None,
        partition_by: str | None = None,
        unique: bool = False,
        by_key: bool = False,
        rows: int = 0,
    ) -> None:
        """Replace data, schema and layout.

        ``bucket_by`` hashes rows into ``buckets`` partitions for merges on those keys. Without a
        number it follows the bytes that the rows are read from; rows that come to over four times as much, as after an
        explode, are placed once more, and merges raise the number as the table grows. ``unique`` records that each key occurs once, ``by_key`` that the rows come from a
        shuffle on the keys, ``rows`` how many are read, if a plan cannot tell.
        """
        if bucket_by and partition_by:
            raise ValueError("a table is either bucketed or partitioned")
        given = buckets
        if bucket_by and not buckets:
            buckets = self.buckets_for(estimated_bytes(df))
        layout = {
            "partition_by": BUCKET if bucket_by else partition_by,
            "bucket_by": bucket_by or [],
            "buckets": buckets or 1,
            "unique": unique,
            "thin": 0,
        }
        n = max(rows, rows_read(df))
        self._commit(self._placed(df, layout, n, by_key), df.schema, layout, self.meta(), dropped=None, n=n)
        if bucket_by and not given and (wanted := self.buckets_wanted()) > buckets:
            self.overwrite(self.read(), bucket_by, wanted, unique=unique)

    def append(self, df: DataFrame) -> None:
        """Add rows with the table's schema to the newest version."""
        meta = self._need()
        layout = {**meta, "unique": False}
        n = rows_read(df)
        self._commit(self._placed(self._checked(df), meta, n), self.schema, layout, meta, dropped=[], n=n)

    def replace(
        self,
        df: DataFrame,
        partitions: list[str],
        unique: bool | None = None,
        by_key: bool = False,
    ) -> None:
        """Replace whole partitions by ``df`` in one step; rows outside them are an error."""
        meta = self._need()
        layout = {**meta, "unique": meta["unique"] if unique is None else unique, "thin": 0}
        n = rows_read(df)
        rows = self._placed(self._checked(df), meta, n, by_key)
        self._commit(rows, self.schema, layout, meta, partitions, set(partitions), n=n)

    def replace_kept(
        self, kept: DataFrame, added: DataFrame, partitions: list[str], thin: bool
    ) -> None:
        """Replace buckets by rows that lie bucket by bucket (``with_bucket``) and some added ones.

        Kept rows are written by the tasks that hold them, only the added ones are shuffled. Where
        those tasks are scans (``thin``), each write may leave one more small file per bucket, so
        the number of such writes since the last full one is recorded.
        """
        meta = self._need()
        rows = kept.unionByName(self._placed(self._checked(added), meta, rows_read(added)))
        layout = {**meta, "thin": meta["thin"] + 1 if thin else 0}
        n = 0 if thin else rows_read(rows)
        self._commit(rows, self.schema, layout, meta, partitions, set(partitions), n=n)

    def replace_files(self, files: list[Row], df: DataFrame) -> None:
        """Replace whole files, as :meth:`files_with` gives them, by ``df``; all others stay where they are."""
        meta = self._need()
        without = {k: list(v) for k, v in meta.get("without", {}).items()}
        for row in files:
            version, partition, name = _IN_TABLE.search(row.file).groups()
            without.setdefault(f"{int(version)}/{partition or ''}", []).append(name)
        stored = meta["bytes"] - sum(row.size for row in files)
        n = rows_read(df)
        rows = self._placed(self._checked(df), meta, n)
        self._commit(rows, self.schema, meta, {**meta, "bytes": stored}, [], without=without, n=n)

    def evolve(self, schema: T.StructType) -> bool:
        """Add the columns and nested fields of a schema, by name; no file is rewritten.

        Old files are read with NULLs for what they lack. Tells whether anything was added.
        """
        meta, own = self._need(), self.schema
        wanted = nullable(union_schema(own, schema))
        if wanted == own:
            return False
        version = max(self._versions()) + 1
        described = {**meta, "version": version, "schema": wanted.jsonValue()}
        self._publish(described, meta)
        return True

    def drop(self, partitions: list[str]) -> None:
        self.replace(self.spark.createDataFrame([], self.schema), partitions)

    def _checked(self, df: DataFrame) -> DataFrame:
        want = {f.name: f.dataType for f in self.schema.fields}
        if {f.name: f.dataType for f in nullable(df.schema).fields} != want:
            raise ValueError(f"schema differs from {self.path}: {df.schema.simpleString()}")
        return df.select(*[quoted(n) for n in want])

    def bucketed(self, df: DataFrame, meta: dict | None = None) -> DataFrame:
        """Add the bucket number of each row."""
        meta = meta or self._need()
        return df.withColumn(BUCKET, bucket_of(df.schema, meta["bucket_by"], meta["buckets"]))

    def _shuffle_partitions(self) -> int:
        initial = self.spark.conf.get(
            "spark.sql.adaptive.coalescePartitions.initialPartitionNum", None
        )
        return int(initial or self.spark.conf.get("spark.sql.shuffle.partitions"))

    def shuffles_fit(self, meta: dict | None = None) -> bool:
        """Whether a shuffle on the keys leaves each task with few buckets, or part of one.

        It does when one of the numbers of shuffle partitions and buckets divides the other.
        """
        number, buckets = self._shuffle_partitions(), (meta or self._need())["buckets"]
        return number % buckets == 0 or buckets % number == 0

    @staticmethod
    def buckets_for(size: int, bucket_bytes: int | None = None) -> int:
        """Number of buckets for so many bytes, whatever the session: the next power of two."""
        each = bucket_bytes or BUCKET_BYTES
        return 1 << max(0, -(-size // each) - 1).bit_length()

    def buckets_wanted(self, bucket_bytes: int | None = None) -> int:
        """Number of buckets for the table's present size, from its stored bytes alone.

        It stays as it is until buckets hold four times what they should, so that the rewrites it
        takes to raise it stay few, and it never falls.
        """
        meta = self._need()
        if meta["bytes"] <= 4 * (bucket_bytes or BUCKET_BYTES) * meta["buckets"]:
            return meta["buckets"]
        return max(meta["buckets"], self.buckets_for(meta["bytes"], bucket_bytes))

    def changed_since(self, version: int, meta: dict | None = None) -> list[str]:
        """Partitions that hold files of versions after the given one, or were made anew since."""
        return [p for p, versions in (meta or self._need())["live"].items() if max(versions) > version]

    def _placed(self, df: DataFrame, layout: dict, n: int, by_key: bool = False) -> DataFrame:
        """Rows with their bucket, few and even files per bucket.

        AQE joins small buckets into one task and splits a hot one over several, but not what one
        task before the shuffle has of it: a bucket of many of the ``n`` rows is dealt out in slices, by a hash
        of each row. Rows that a shuffle on the keys has already brought together need no second one.
        """
        if not layout["bucket_by"]:
            return df
        rows = self.bucketed(df, layout)
        if by_key and self.shuffles_fit(layout):
            return rows
        slices = -(-n // (layout["buckets"] * TASK_ROWS))
        if slices < 2:
            return rows.hint("rebalance", F.col(BUCKET))
        part = fresh("_slice", rows.columns)
        hashed = [quoted(f.name) for f in df.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]
        sliced = rows.withColumn(part, F.pmod(F.xxhash64(*hashed), F.lit(slices)))
        return sliced.hint("rebalance", F.col(BUCKET), quoted(part)).drop(part)

    def _commit(self, df, schema, layout, previous, dropped, only=None, without=None, n=0) -> None:
        taken = {VERSION} | ({BUCKET} if layout["bucket_by"] else set())
        clash = sorted(n for n in schema.names if n.lower() in taken)
        if clash:
            raise ValueError(f"{self.path}: the layout of stored tables needs the names {clash}")
        version = max(self._versions(), default=0) + 1
        folder, part = self._folder(version), layout["partition_by"]
        writer = df.write.mode("errorifexists")
        with dealt_by_rows(df.sparkSession, n):
            (writer.partitionBy(part) if part else writer).parquet(folder)

        if part:
            written = [n for n in fs.names(self.spark, folder) if n.startswith(f"{part}=")]
        else:
            written = [""]
        if only is not None and not set(written) <= only:
            raise ValueError(f"rows outside the replaced partitions: {sorted(set(written) - only)}")
        live, bytes_ = {}, fs.size(self.spark, folder)
        if previous and previous["live"] and dropped is not None:
            live = {p: v for p, v in previous["live"].items() if p not in set(dropped)}
            # Estimated: buckets are of like size.
            bytes_ += previous["bytes"] * len(live) // len(previous["live"])
        for partition in written:
            live[partition] = live.get(partition, []) + [version]
        meta = {
            "version": version,
            "schema": nullable(schema).jsonValue(),
            "partition_by": part,
            "bucket_by": layout["bucket_by"],
            "buckets": layout["buckets"],
            "unique": layout["unique"],
            "thin": layout["thin"],
            "marks": {**(previous or {}).get("marks", {}), **dict([self.mark] if self.mark else [])},
            "bytes": bytes_,
            "live": live,
        }
        known = (previous or {}).get("without", {}) if without is None else without
        used = {f"{v}/{p}" for p, versions in live.items() for v in versions}
        meta["without"] = {k: names for k, names in known.items() if k in used}
        self._publish(meta, previous)

    def _publish(self, meta: dict, previous: dict | None) -> None:
        """Make a version count, if the one it was made from is still the newest."""
        if (self.meta() or {}).get("version") != (previous or {}).get("version"):
            raise RuntimeError(f"another writer changed {self.path}")
        fs.write_text(self.spark, f"{self._folder(meta['version'])}/{_META}", json.dumps(meta))

    def purge(self, keep: int = 2) -> None:
        """Delete files that none of the newest ``keep`` versions uses."""
        kept, oldest = [], None
        for version in self._versions():
            found = self._load_meta(version)
            if found:
                kept.append(found)
                oldest = version
            if len(kept) == keep:
                break
        if not kept:
            return
        needed = {(v, p) for meta in kept for p, vs in meta["live"].items() for v in vs}
        for version in self._versions():
            if version >= oldest:
                continue
            folder = self._folder(version)
            parts = [p for v, p in needed if v == version]
            if not parts:
                fs.delete(self.spark, folder)
                continue
            for name in fs.names(self.spark, folder):
                if "=" in name and name not in parts:
                    fs.delete(self.spark, f"{folder}/{name}")
