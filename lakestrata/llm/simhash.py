"""Near-duplicate groups by SimHash fingerprints, linked exactly through vantage-point trees.

A text's fingerprint has a bit set where more than half of its shingles' hashes (XXH64 of the UTF-8 bytes) have it; repeated
shingles count each time. Words are runs of anything but blanks, lower-cased (A-Z); a text of fewer words than a
shingle is one shingle, and texts without words, nulls too, have the fingerprint zero and are linked like any other.

Fingerprints that differ in at most ``radius`` bits are linked. Equal ones are one point, however many documents share
it. A bounded sample of points gives a tree of vantage points that deals all points to cells; those near the boundary
of a cell also go to the cell that compares both sides of it (:mod:`lakestrata.llm.vantage`), so every pair of close
points meets in one cell. A task takes one cell, or two blocks of a large one, and gives back links that join what the
pairs it found join, at most one for each point. Groups are connected over stored tables.

The component id is the least id that can be reached (null where no document of the group has one, and then groups share
it); repeated rows stay apart, each with the id of its group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestrata.llm.components import components
from lakestrata.llm.frames import inputs, slices, small_batches, stored
from lakestrata.llm.vantage import Router, forest, pairs, router

BLANK = re.compile(rb"[\x20\x09-\x0D]")
SHINGLE = 3
RADIUS = 2
SEED = 42
BATCH_BYTES = 2 << 20
#: A long text is hashed in pieces of so many bytes.
PIECE_BYTES = 1 << 20
#: Points that make the upper levels of the tree; they decide how even cells are, not what is found.
SAMPLE = 20_000
#: Points expected in a cell, more where there would be more than ``CELLS`` cells of one side.
CELL = 16_384
CELLS = 1024
#: Points of a side of a cell that a task holds at a time.
BLOCK = 1 << 18
#: A key that more than one row in so many has is looked up by broadcast: there are no more than that many.
HOT = 1000


def _words(text: bytes, overlap: int) -> Iterator[list[bytes]]:
    """The words of a text, of a long one in pieces that begin with the last words of the one before."""
    at, before = 0, []
    while at < len(text):
        gap = BLANK.search(text, at + PIECE_BYTES)
        stop = gap.end() if gap else len(text)
        piece, at = text[at:stop], stop
        found = before + piece.lower().split()
        before = found[-overlap:] if overlap else []
        yield found


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> Iterator[np.ndarray]:
    """The hash of every shingle, repeats included."""
    whole: list[bytes] = []
    short = True
    for found in _words(text, size - 1):
        if len(found) < size:
            whole = found
            continue
        short = False
        ends = np.cumsum([len(w) + 1 for w in found])
        line = b" ".join(found)
        starts = [0, *ends[:-size].tolist()]
        stops = (ends[size - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        yield np.array([digest(line[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64)
    if short and whole:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(whole), seed)], np.uint64)


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as an unsigned number."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, size, seed):
        for i in range(0, len(hashes), 1 << 16):
            bits = np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int32)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _signed(rows: DataFrame, size: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, BATCH_BYTES):
            texts = [bytes(t.as_buffer() or b"") if t.is_valid else b"" for t in batch.column(1)]
            found = np.array([fingerprint(t, size, seed) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _dealt(points: DataFrame, tree: Router) -> DataFrame:
    """Every place of a point: (cell, side, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            at, cell, side = tree.deal(own.view(np.uint64))
            arrays = [pa.array(cell, pa.int32()), pa.array(side, pa.int8()), pa.array(own[at])]
            yield pa.RecordBatch.from_arrays(arrays, ["cell", "side", "fp"])

    return points.mapInArrow(run, "cell int, side byte, fp long")


def _blocked(places: DataFrame) -> DataFrame:
    """Places with the two blocks that meet: blocks of a cell with each other, those of one side with those of the other."""
    count = places.groupBy("cell").pivot("side", [0, 1]).count().na.fill(0)
    n = [F.greatest(F.lit(1), F.ceil(F.col(side) / F.lit(BLOCK))).cast("int") for side in ("0", "1")]
    sizes = count.select("cell", (F.col("1") > 0).alias("two"), n[0].alias("n0"), n[1].alias("n1"))
    rows = places.join(F.broadcast(sizes), "cell")  # as many rows as the tree has cells
    own = F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1"))
    other = F.when(F.col("two") & (F.col("side") == 0), F.col("n1")).otherwise(F.col("n0"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("fp", F.lit(7)), own).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), other - 1)))
    first = F.when(F.col("two"), F.when(F.col("side") == 0, F.col("block")).otherwise(F.col("other")))
    second = F.when(F.col("two"), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("block")))
    return rows.select(
        "cell",
        F.coalesce(first, F.least("block", "other")).alias("i"),
        F.coalesce(second, F.greatest("block", "other")).alias("j"),
        # rows of one side of what is compared; all alike where a block meets itself
        F.when(F.col("two"), F.col("side").cast("int")).otherwise((F.col("block") != F.least("block", "other")).cast("int")).alias("side"),
        ((F.col("two")) | (F.col("block") != F.col("other"))).alias("cross"),
        "block",
        "fp",
    )


def _links(points: DataFrame, radius: int, total: int) -> DataFrame:
    """Links that join just the points which chains of close ones join."""
    share = -(-SAMPLE * (1 << 30) // max(total, 1))
    chosen = points.filter(F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(1 << 30)) < share)
    sample = np.array(sorted(r.fp for r in chosen.collect()), np.int64).view(np.uint64)
    sample = np.random.default_rng(1).permutation(sample)
    tree = router(sample, total / max(len(sample), 1), max(CELL, total / CELLS), radius)
    places = stored(_dealt(points, tree))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        fps = part["fp"].to_numpy()
        own = fps.view(np.uint64)
        if part["cross"].any():
            side = part["side"].to_numpy() == 0
            first, second = np.flatnonzero(side), np.flatnonzero(~side)
            x, y = pairs(own[first], radius, own[second])
            x, y = first[x], second[y]
        else:
            x, y = pairs(own, radius)
        a, b = forest(len(own), x, y)
        return pd.DataFrame({"a": fps[a], "b": fps[b]}, dtype="int64")

    # a block of a cell of one side meets itself without and any other with sides, never both under one (i, j)
    return _blocked(places).groupBy("cell", "i", "j").applyInPandas(run, "a long, b long")


def _looked_up(rows: DataFrame, key: str, table: DataFrame, total: int) -> DataFrame:
    """The rows with their key's ``found``, from a table (key, found, n) that says how many rows have the key."""
    often = F.col("n") * HOT > total
    hot = table.filter(often).select(key, "found", F.lit(True).alias("hit"))
    cold = table.filter(~often).select(key, "found")
    met = rows.join(F.broadcast(hot), key, "left")
    rest = met.filter("hit IS NULL").drop("found", "hit").join(cold, key)
    return met.filter("hit").drop("hit").select(*rows.columns, "found").unionByName(rest.select(*rows.columns, "found"))


def classes(
    df: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE,
    radius: int = RADIUS,
    seed: int = SEED,
) -> DataFrame:
    """Per row its id, ``fingerprint`` (16 hex digits) and ``component_id``."""
    small_batches(df.sparkSession)
    signed = stored(_signed(inputs(df, id=id, text=text), size, seed))
    points = stored(signed.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    total, rows = points.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    links = stored(_links(points.select("fp"), radius, total))
    group = components(links).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = points.join(group, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stored(rooted)
    least = rooted.groupBy("root").agg(F.min("least").alias("found"), F.count("*").alias("n"))
    named = stored(_looked_up(rooted.select("root", "fp", F.col("n").alias("copies")), "root", least, total))
    found = _looked_up(signed, "fp", named.select("fp", "found", F.col("copies").alias("n")), rows)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.select(F.col("id").alias(id), digits, F.col("found").alias("component_id"))
