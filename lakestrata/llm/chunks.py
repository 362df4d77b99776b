"""Documents stored in order as chunks of a few megabytes, and questions the chunks ask about hashes.

A chunk is one row with its documents, so its place among all chunks tells which documents come earlier.
The table is bucketed by chunk: passes over the documents that need what was found out about a chunk join
without moving any text. Chunks send their distinct hashes, sorted and packed, to buckets by the hash's range;
a hash takes part once per chunk however often it occurs, so that no hash makes a bucket large.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestrata.llm.frames import column, small_batches, stored, table_bytes
from lakestrata.session import scratch_dir

CHUNK_BYTES = 4 << 20
PARTITION_BYTES = 8 << 20
#: Partitions hold more than that where there would be more of them; tasks go through them chunk by chunk.
MOST_PARTITIONS = 20_000
#: Bytes of text whose hashes meet in one bucket.
BUCKET_BYTES = 16 << 20

REPLIES = "chunk long, level int, bucket int, bits binary"


@dataclass
class Chunks:
    """The stored table: rows (chunk, ids, texts, rest), how many bytes of text and documents it has."""

    table: str
    kinds: str
    parts: int
    text_bytes: int
    rows: int

    @property
    def buckets(self) -> int:
        return max(64, -(-self.text_bytes // BUCKET_BYTES))


def chunked(df: DataFrame, id: str, text: str, carry: bool = False) -> Chunks:
    """Store documents ordered by id, then text; ``carry`` keeps whole rows too, as ``rest``."""
    spark = df.sparkSession
    small_batches(spark)
    names = {"id": id, "text": text}
    rows = df.select(*[column(df, name).alias(own) for own, name in names.items()])
    if carry:
        rows = df.select(
            *[column(df, name).alias(own) for own, name in names.items()],
            F.struct(*[column(df, c) for c in df.columns]).alias("rest"),
        )
    parts = min(MOST_PARTITIONS, -(-table_bytes(df) // PARTITION_BYTES))
    parts = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = "chunk long, bytes long, n long, " + ", ".join(f"{n} array<{k}>" for n, k in kinds.items())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        kept: list[pa.RecordBatch] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            nonlocal first
            table = pa.Table.from_batches(kept).combine_chunks()
            n = table.num_rows
            lists = [
                pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c.chunk(0) if c.num_chunks else pa.array([], c.type))
                for c in table.columns
            ]
            first += 1
            fixed = [pa.array([v], pa.int64()) for v in (first - 1, size, n)]
            return pa.RecordBatch.from_arrays([*fixed, *lists], ["chunk", "bytes", "n", *kinds])

        for batch in batches:
            start = 0
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for i, more in enumerate(sizes):
                size += int(more)
                if size >= CHUNK_BYTES:
                    kept.append(batch.slice(start, i + 1 - start))
                    yield chunk()
                    kept, size, start = [], 0, i + 1
            if start < batch.num_rows:
                kept.append(batch.slice(start))
        if kept:
            yield chunk()

    ordered = rows.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")
    name = f"chunks_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/chunks"
    packed = ordered.mapInArrow(pack, schema)
    packed.write.option("path", path).option("compression", "zstd").bucketBy(parts, "chunk").saveAsTable(name)
    total = spark.table(name).agg(F.sum("bytes"), F.sum("n")).first()
    return Chunks(name, kinds, parts, total[0] or 0, total[1] or 0)


def visit(chunks: Chunks, df_replies: DataFrame | None, function: Callable, schema: str, rest: bool = False) -> DataFrame:
    """``function(chunk, ids, texts, rest, replies)`` for every chunk, as a generator of Arrow batches.

    ``replies`` maps (level, bucket) to the bytes that came back for the chunk.
    """
    spark = SparkSession.active()
    columns = ["chunk", "id", "text", *(["rest"] if rest else [])]
    docs = spark.table(chunks.table).select(*columns)
    if df_replies is not None:
        packed = df_replies.groupBy("chunk").agg(F.collect_list(F.struct("level", "bucket", "bits")).alias("replies"))
        docs = docs.join(packed.repartition(chunks.parts, "chunk").hint("shuffle_hash"), "chunk", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.schema.get_field_index(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids, texts = (row.column(at[n]).flatten() for n in ("id", "text"))
                more = row.column(at["rest"]).flatten() if rest else None
                replies = {}
                if "replies" in at:
                    replies = {(r["level"], r["bucket"]): r["bits"] for r in row.column(at["replies"])[0].as_py() or []}
                yield from function(row.column(at["chunk"])[0].as_py(), ids, texts, more, replies)

    return docs.mapInArrow(run, schema)


def joined(texts: pa.Array, gap: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in one array with ``gap`` after each, and where each starts (one more: the end)."""
    parts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + len(gap) for p in parts], out=starts[1:])
    return np.frombuffer(gap.join([*parts, b""]), np.uint8), starts


# sorted numbers as bytes


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers: gaps by byte planes, so that the high planes compress."""
    gaps = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    planes = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    gaps = np.zeros((planes.shape[1], 8), np.uint8)
    gaps[:, : data[0]] = planes.T
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


def shrink(data: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data.tobytes())


def widen(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def cuts(values: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's share of sorted 64-bit hashes starts, and the end."""
    edges = [min((b << 64) // buckets, (1 << 64) - 1) for b in range(buckets)]
    return np.append(np.searchsorted(values, np.array(edges, np.uint64)), len(values))


# which hashes other chunks have too

ASKED = "bucket int, chunk long, level int, codes binary"


def ask(chunk: int, level: int, values: np.ndarray, buckets: int, drop_bits: int) -> Iterator[pa.RecordBatch]:
    """A chunk's distinct sorted hashes for the buckets; ``drop_bits`` low bits are left out."""
    at = cuts(values, buckets)
    rows = [(b, values[x:y]) for b, (x, y) in enumerate(zip(at, at[1:], strict=False)) if y > x]
    if rows:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([b for b, _ in rows], pa.int32()),
                pa.array([chunk] * len(rows), pa.int64()),
                pa.array([level] * len(rows), pa.int32()),
                pa.array([pack(v >> np.uint64(drop_bits)) for _, v in rows], pa.binary()),
            ],
            ["bucket", "chunk", "level", "codes"],
        )


def answer(asked: DataFrame, earlier: bool) -> DataFrame:
    """A bit for every hash a chunk sent: an (``earlier``) other chunk has it too. Stored, so it is worked out once."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk", ignore_index=True)
        lists = [unpack(c) for c in rows.codes]
        values = np.concatenate(lists)
        order = np.argsort(values, kind="stable")  # by hash, then by chunk
        values = values[order]
        same = values[1:] == values[:-1]
        bits = np.zeros(len(values), bool)
        bits[order[1:]] = same
        if not earlier:
            bits[order[:-1]] |= same
        ends = np.cumsum([len(x) for x in lists])
        rows["bits"] = [np.packbits(x).tobytes() for x in np.split(bits, ends[:-1])]
        return rows[["chunk", "level", "bucket", "bits"]]

    return stored(asked.groupBy("bucket").applyInPandas(run, REPLIES))


def heard(replies: dict, level: int, values: np.ndarray, buckets: int) -> np.ndarray:
    """The answers for a chunk's distinct sorted hashes, in their order."""
    at = cuts(values, buckets)
    bits = [
        np.unpackbits(np.frombuffer(replies[level, b], np.uint8), count=y - x)
        for b, (x, y) in enumerate(zip(at, at[1:], strict=False))
        if y > x
    ]
    return np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
