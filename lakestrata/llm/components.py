"""Connected groups of a graph that is never in one place: forests of blocks, then alternating stars over stored tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestrata.llm.frames import stored
from lakestrata.llm.vantage import forest

#: Links that a task takes at a time; tables of links are written by a task for so many at least.
LINKS = 1 << 18


def _forests(links: DataFrame) -> DataFrame:
    """Links (a, least b of its group) that join just what each block of links joins."""
    most = LINKS

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = np.concatenate([batch.column(i).to_numpy() for i in range(2) for batch in held])
        points, at = np.unique(ends, return_inverse=True)
        a, b = forest(len(points), *np.split(at, 2))
        return pa.RecordBatch.from_arrays([pa.array(points[a]), pa.array(points[b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held, size = [*held, batch], size + batch.num_rows
            if size >= most:
                yield joined(held)
                held, size = [], 0
        if held:
            yield joined(held)

    return links.mapInArrow(run, "a long, b long")


def _flat(edges: DataFrame) -> bool:
    """Whether every number hangs on one other at most, which hangs on none."""
    ends = edges.select(F.col("a").alias("k"), F.col("b").alias("on"))
    ends = ends.unionByName(edges.select(F.col("b").alias("k"), F.lit(None).cast("long").alias("on")))
    per = ends.groupBy("k").agg(F.min("on").alias("x"), F.max("on").alias("y"), F.max(F.col("on").isNull()).alias("held"))
    return per.filter("x != y OR (x IS NOT NULL AND held)").agg(F.count("*")).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """From stored links (a, b) between numbers: every linked number as ``a`` and its group's least as ``b``, but that itself.

    Blocks of links first become forests in their tasks. Each round then hangs what is above a number on the least of its
    neighbours, then joins the neighbours below it; both take a minimum per number and a join, in which a number with many
    links can be split. The number of rounds grows with the logarithm of the largest group; flat groups take none.
    """
    links = links.filter("a != b").select("a", "b")
    parts = max(1, -(-links.count() // LINKS))
    edges = stored(_forests(links.coalesce(parts)).distinct().coalesce(parts))
    while not _flat(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        least = least.select("k", F.least("k", "m").alias("m"))
        above = both.filter("b > a").join(least, F.col("a") == F.col("k"))
        large = above.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        root = large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        below = large.join(root, F.col("a") == F.col("k")).filter("b != m")
        small = below.select(F.col("b").alias("a"), F.col("m").alias("b"))
        rows = small.unionByName(root.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()
        edges = stored(rows.coalesce(parts))
    return edges
