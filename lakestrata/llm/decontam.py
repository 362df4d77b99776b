"""Benchmark passages in documents, found by Wu-Manber search over words.

Patterns are the windows of ``window`` words of every benchmark item; an item of fewer words, but not none, is one
pattern. Patterns of equal length share two tables. The shift table tells, from a block of two words, how far the end
of a window may move on because no pattern can end before; where it says 0, the patterns that end in that block are
looked up by the block's hash and compared word by word. Many stretches of text advance at once, each with its own
shifts.

Words are lower-cased (A-Z) runs of letters, digits and bytes beyond ASCII; null texts have none. A null item id shows
as ``null``. Rows that repeat an item count once, and long items are cut into pieces that keep every window whole.
Patterns are sent to executors in blocks of about half of ``PATTERNS_PER_BLOCK`` whatever the benchmark's size, one block
at a time; with more than one block, hits are put together by row.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestrata.llm.chunks import joined
from lakestrata.llm.frames import column, inputs, slices, small_batches, stored
from lakestrata.llm.hashing import LOWER, MARKS, mix, words

WINDOW = 13
PATTERNS_PER_BLOCK = 500_000
BATCH_BYTES = 4 << 20
#: Words a stretch of text has; stretches advance together.
STRETCH = 64


def normal_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, and where each text's begin (one more: the end)."""
    data, starts = joined(texts, b" ")
    begins, _, hashes = words(LOWER[data], MARKS)
    return hashes, np.searchsorted(begins, starts)


class _Length:
    """The tables for the patterns of one length."""

    def __init__(self, patterns: np.ndarray, owners: list[list[int]]):
        self.patterns, self.owners, self.size = patterns, owners, patterns.shape[1]
        self.block = min(2, self.size)
        self.bits = max(16, int(len(patterns) * self.size).bit_length() + 3)
        most = self.size - self.block + 1
        self.shift = np.full(1 << self.bits, most, np.uint8 if most < 256 else np.int64)
        for end in range(self.block - 1, self.size):
            np.minimum.at(self.shift, self.slot(self.hash(patterns, end)), self.size - 1 - end)
        suffix = self.hash(patterns, self.size - 1)
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.bucket = suffix[order], order

    def hash(self, rows: np.ndarray, end: int) -> np.ndarray:
        first = rows[..., end - 1] if self.block == 2 else np.uint64(0)
        return mix(first * np.uint64(3) ^ rows[..., end])

    def slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, text: np.ndarray, ends_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of occurrences and their patterns; ``ends_at`` has the end of each word's document."""
        last = self.size - 1
        at = np.arange(last, len(text), STRETCH)  # the last word of each stretch's window
        stop = np.minimum(at + STRETCH, len(text))
        candidates, blocks = [], []
        while len(at):
            before = text[at - 1] * np.uint64(3) if self.block == 2 else np.uint64(0)
            hashes = mix(before ^ text[at])
            shift = self.shift[self.slot(hashes)]
            hit = shift == 0
            candidates.append(at[hit] - last)
            blocks.append(hashes[hit])
            at = at + np.maximum(shift, 1)
            go = at < stop
            at, stop = at[go], stop[go]
        starts = np.concatenate(candidates) if candidates else np.zeros(0, np.int64)
        hashes = np.concatenate(blocks) if blocks else np.zeros(0, np.uint64)
        inside = starts + self.size <= ends_at[starts]
        starts, hashes = starts[inside], hashes[inside]
        low, high = np.searchsorted(self.suffix, hashes, "left"), np.searchsorted(self.suffix, hashes, "right")
        found, which = [], []
        while len(starts):  # the next pattern of each bucket
            go = low < high
            starts, low, high = starts[go], low[go], high[go]
            pattern = self.bucket[low]
            same = np.ones(len(starts), bool)
            for i in range(self.size):
                same &= text[starts + i] == self.patterns[pattern, i]
            found.append(starts[same])
            which.append(pattern[same])
            low = low + 1
        empty = np.zeros(0, np.int64)
        return np.concatenate([*found, empty]), np.concatenate([*which, empty])


class Search:
    """All patterns of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = [name for name, _ in items]
        hashes, starts = normal_words(pa.array([text for _, text in items], pa.string()))
        by_size: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
            size = min(window, b - a)
            for i in range(a, b - size + 1 if size else a):
                owners = by_size[size][hashes[i : i + size].tobytes()]
                if not owners or owners[-1] != k:
                    owners.append(k)
        self.lengths = [
            _Length(np.frombuffer(b"".join(found), np.uint64).reshape(-1, size), list(found.values()))
            for size, found in sorted(by_size.items())
        ]

    def hits(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, list[str]]]:
        """Per text its number of words, which of them an occurrence covers, and the items that occur."""
        text, starts = normal_words(texts)
        ends_at = np.repeat(starts[1:], np.diff(starts))
        change = np.zeros(len(text) + 1, np.int32)
        items: dict[int, set[int]] = defaultdict(set)
        for length in self.lengths:
            found, which = length.search(text, ends_at)
            np.add.at(change, found, 1)
            np.add.at(change, found + length.size, -1)
            rows = np.searchsorted(starts, found, "right") - 1
            for row, pattern in np.unique(np.stack([rows, which], axis=1), axis=0).tolist():
                items[row].update(length.owners[pattern])
        covered = np.cumsum(change[:-1]) > 0
        for row, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
            yield b - a, covered[a:b], sorted({self.names[k] for k in items.get(row, ())})


_SEARCHES: dict[str, Search] = {}


def _search(block: Broadcast, window: int) -> Search:
    name, items = block.value
    if name not in _SEARCHES:
        _SEARCHES.clear()  # one block at a time
        _SEARCHES[name] = Search(items, window)
    return _SEARCHES[name]


def pieces(text: str, window: int, most: int) -> Iterator[str]:
    """A text cut into pieces of at most ``most`` windows each; neighbours share the words of windows across cuts."""
    data = np.frombuffer(text.encode(), np.uint8)
    begins, ends, _ = words(LOWER[data], MARKS)
    for at in range(0, max(1, len(begins) - window + 1), most):
        last = min(at + most + window - 1, len(begins)) - 1
        if last >= at:
            yield data[begins[at] : ends[last]].tobytes().decode()


def _pieces(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """(item, text, n): distinct pieces of the items, with their numbers of words (stored)."""
    most = max(1, PATTERNS_PER_BLOCK // 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, BATCH_BYTES):
            for name, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cut = list(pieces(whole, window, most))
                n = [int(normal_words(pa.array([c], pa.string()))[1][-1]) for c in cut]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(cut), pa.string()), pa.array(cut, pa.string()), pa.array(n, pa.int64())], ["item", "text", "n"])

    rows = inputs(benchmark, item=item, text=text).filter("text IS NOT NULL")
    rows = rows.select(F.coalesce(F.col("item").cast("string"), F.lit("null")).alias("item"), "text")
    return stored(rows.mapInArrow(run, "item string, text string, n long").distinct())


def _blocks(parts: DataFrame, count: int) -> Iterator[Broadcast]:
    """The pieces in blocks of bounded size, one after the other."""
    block = F.pmod(F.xxhash64("item", "text"), F.lit(count))
    for b in range(count):
        found = parts.filter(block == b).select("item", "text").collect()
        yield parts.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [tuple(r) for r in found]))


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    carry: bool = False,
) -> DataFrame:
    """Per row its id, ``n_words``, ``n_hit``, ``items`` (sorted names), ``n_items`` and ``contaminated``.

    A document is contaminated when a twentieth of its words or more lie in occurrences of patterns. ``carry`` adds the
    whole input row as ``rest``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(column(docs, id).alias("id"), column(docs, text).alias("text"))
    if carry:
        rest = F.struct(*[column(docs, c) for c in docs.columns]).alias("rest")
        rows = docs.select(column(docs, id).alias("id"), column(docs, text).alias("text"), rest)
    parts = _pieces(benchmark, item, item_text, window)
    # blocks are filled to a half, as hashes spread pieces unevenly
    count = max(1, -(-2 * (parts.agg(F.sum("n")).first()[0] or 0) // PATTERNS_PER_BLOCK))
    blocks = _blocks(parts, count)
    found = _one_block(rows, next(blocks), window) if count == 1 else _many_blocks(rows, blocks, window)
    share = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return found.select(
        F.col("id").alias(id),
        "n_words",
        "n_hit",
        "items",
        F.size("items").cast("long").alias("n_items"),
        share.alias("contaminated"),
        *(["rest"] if carry else []),
    )


def _schema(rows: DataFrame) -> str:
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return f"{kept}, n_words long, n_hit long, items array<string>"


def _one_block(rows: DataFrame, items: Broadcast, window: int) -> DataFrame:
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, BATCH_BYTES):
            found = list(_search(items, window).hits(batch.column(1)))
            arrays = [
                pa.array([f[0] for f in found], pa.int64()),
                pa.array([int(f[1].sum()) for f in found], pa.int64()),
                pa.array([f[2] for f in found], pa.list_(pa.string())),
            ]
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, *arrays], [*names, "n_words", "n_hit", "items"])

    return rows.mapInArrow(run, _schema(rows))


def _many_blocks(rows: DataFrame, blocks: Iterator[Broadcast], window: int) -> DataFrame:
    """Rows are numbered and stored; each block adds what it covers, and only texts with hits meet again."""
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    hits = None
    for items in blocks:

        def run(batches: Iterator[pa.RecordBatch], items: Broadcast = items) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1, BATCH_BYTES):
                out = []
                for row, (n, covered, names) in zip(batch.column(0).to_pylist(), _search(items, window).hits(batch.column(1)), strict=True):
                    out.append((row, n, np.packbits(covered).tobytes(), names))
                arrays = [pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "n_words", "bits", "items"])

        part = stored(rows.select("row", "text").mapInArrow(run, "row long, n_words long, bits binary, items array<string>"))
        items.destroy()  # what it found is stored
        hits = part if hits is None else hits.unionByName(part)

    def together(parts: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in parts.bits])
        items = sorted({i for part in parts["items"] for i in part})
        return pd.DataFrame([(parts.row[0], parts.n_words[0], int(np.unpackbits(bits).sum()), items)], columns=["row", "n_words", "n_hit", "items"])

    merged = hits.groupBy("row").applyInPandas(together, "row long, n_words long, n_hit long, items array<string>")
    return rows.drop("text").join(merged, "row").drop("row")
