"""Near-duplicate groups by ProbMinHash signatures, banding and exact verification.

A document is the multiset of its five-word shingles, whose counts are weights. The similarity is the probability
Jaccard index: the sum over common shingles d of 1 / sum over d' of max(x(d') / x(d), y(d') / y(d)); without repeated
shingles it is the Jaccard index. A signature has a register for each of ``BANDS * ROWS`` positions. Every
shingle sends arrivals of a Poisson process whose rate is its weight to registers drawn by hash; a register keeps the
shingle that arrives first, and a shingle stops when its next arrival is later than all registers.

Equal word sequences are one node. Nodes that agree in a band share a bucket. First each node is verified against one
leader of its buckets, twice with other leaders, which closes most groups of copies at a pair per copy. Buckets that
still hold several groups are then compared whole, by tasks that hold a block of nodes against another with their sets
of shingles and give back only links that join two groups. So every two nodes that share a bucket and end in different
groups have been compared exactly, no list of pairs is ever made, and a large bucket is many bounded tasks.

Words are lower-cased (A-Z) runs of letters, digits and bytes beyond ASCII. A text of fewer than five words is one
shingle. Null texts and texts without words are alone in their class. Rows that repeat an id and a text are one
document; the class id is the least id in the class (null if it has none). Nodes are 64-bit hashes of word sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestrata.llm.chunks import pack, unpack
from lakestrata.llm.components import components
from lakestrata.llm.decontam import normal_words
from lakestrata.llm.frames import column, inputs, slices, small_batches, stored
from lakestrata.llm.hashing import mix, prefix_sums, span_hashes

SHINGLE = 5
BANDS = 25
ROWS = 5
LEAST = 0.8
STARS = 2
#: Nodes of a bucket that a task holds at a time, on either side; bytes of sets that meet in one group of buckets.
BLOCK = 512
GROUP_BYTES = 16 << 20
COLUMNS = 4096
BATCH_BYTES = 2 << 20


def nodes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for each text's word sequence, as a signed 64-bit one."""
    return span_hashes(prefix_sums(hashes), starts[:-1], starts[1:]).astype(np.int64)


def shingles(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) pairs in order, and how often each occurs."""
    size = np.diff(starts)
    count = np.where(size > 0, np.maximum(size - SHINGLE + 1, 1), 0)
    text = np.repeat(np.arange(len(size)), count)
    at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + starts[text]
    found = span_hashes(prefix_sums(hashes), at, np.minimum(at + SHINGLE, starts[text + 1]))
    order = np.lexsort((found, text))
    text, found = text[order], found[order]
    new = np.append(True, (text[1:] != text[:-1]) | (found[1:] != found[:-1]))[: len(text)]
    first = np.flatnonzero(new)
    return text[first], found[first], np.diff(np.append(first, len(text)))


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """The shingle that arrives first in each register of each of ``n`` texts, by ProbMinHash."""
    first = np.full(n * registers, np.inf)
    kept = np.zeros(n * registers, np.uint64)
    time = np.zeros(len(shingle))
    step = np.uint64(0)
    while len(shingle):
        step += np.uint64(1)
        draw = mix(shingle ^ mix(np.full(1, step, np.uint64)))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weight
        register = (mix(draw) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)
        at = text * registers + register.astype(np.int64)
        early = np.flatnonzero(time < first[at])
        np.minimum.at(first, at[early], time[early])
        won = early[time[early] == first[at[early]]]
        kept[at[won]] = shingle[won]
        # a shingle goes on while a register of its text is later than its last arrival
        latest = first.reshape(n, registers).max(axis=1)
        on = time < latest[text]
        text, shingle, weight, time = text[on], shingle[on], weight[on], time[on]
    return kept.reshape(n, registers)


def bands(signature: np.ndarray) -> np.ndarray:
    """One number for each band of each text; bands of different places never agree."""
    rows = signature.reshape(len(signature), BANDS, ROWS)
    out = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64)), rows.shape[:2]).copy()
    for i in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) ^ rows[:, :, i])
    return out.astype(np.int64)


def similarity(x: np.ndarray, xw: np.ndarray, y: np.ndarray, yw: np.ndarray) -> float:
    """The probability Jaccard index of two weighted sets of sorted shingles."""
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    both = np.stack([xw[i], yw[j]]).astype(np.float64)
    only_x, only_y = xw.sum() - both[0].sum(), yw.sum() - both[1].sum()
    # sum over d' of max(x(d') / x(d), y(d') / y(d)): by the ratio x / y of d' against that of d
    ratio = both[0] / both[1]
    order = np.argsort(ratio, kind="stable")
    ratio, xs, ys = ratio[order], both[0][order], both[1][order]
    x_from = np.append(np.cumsum(xs[::-1])[::-1], 0.0)  # of those with at least this ratio
    y_below = np.append(0.0, np.cumsum(ys))
    cut = np.searchsorted(ratio, ratio, "left")
    total = (x_from[cut] + only_x) / xs + (y_below[cut] + only_y) / ys
    return float((1 / total).sum())


# stages


def _signed(rows: DataFrame) -> DataFrame:
    """Per row: id, node and bands (none for texts without words), and a hash of the text as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, BATCH_BYTES):
            hashes, starts = normal_words(batch.column(1))
            text, shingle, weight = shingles(hashes, starts)
            found = bands(signatures(text, shingle, weight, batch.num_rows, BANDS * ROWS))
            some = np.diff(starts) > 0
            own = pa.array(nodes(hashes, starts), mask=~some)
            lists = pa.ListArray.from_arrays(
                pa.array(np.append(0, np.cumsum(some * BANDS)), pa.int32()), pa.array(found[some].ravel())
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), own, lists, batch.column(2)], ["id", "node", "bands", "told"])

    kind = rows.schema["id"].dataType.simpleString()
    told = rows.select("id", "text", F.xxhash64("text").alias("told"))
    return told.mapInArrow(run, f"id {kind}, node long, bands array<long>, told long")


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The shingles of the nodes in ``wanted`` (node, one), each from the rows of one id and text."""
    asked = wanted.select("node", F.col("one.id").alias("of"), F.col("one.told").alias("told"))
    rows = rows.withColumn("same", F.xxhash64("text"))
    texts = rows.join(asked, F.col("id").eqNullSafe(F.col("of")) & (F.col("same") == F.col("told"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, BATCH_BYTES):
            hashes, starts = normal_words(batch.column(1))
            own = nodes(hashes, starts) == batch.column(0).to_numpy()
            text, shingle, weight = shingles(hashes, starts)
            cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
            kept = np.flatnonzero(own)
            parts = [slice(cut[i], cut[i + 1]) for i in kept]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(kept)),
                    pa.array([pack(shingle[p] >> np.uint64(16)) for p in parts], pa.binary()),
                    pa.array([weight[p].astype(np.uint32).tobytes() for p in parts], pa.binary()),
                ],
                ["node", "shingles", "weights"],
            )

    return texts.mapInArrow(run, "node long, shingles binary, weights binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes that are similar enough, by their whole sets of shingles."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.col("weights").alias("wa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.col("weights").alias("wb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sa, wa, sb, wb = (batch.column(batch.schema.get_field_index(n)) for n in ("a", "b", "sa", "wa", "sb", "wb"))
            good = []
            for i in range(batch.num_rows):
                xw, yw = (np.frombuffer(w[i].as_buffer(), np.uint32) for w in (wa, wb))
                good.append(similarity(unpack(sa[i].as_buffer().to_pybytes()), xw, unpack(sb[i].as_buffer().to_pybytes()), yw) >= least)
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long")


def _groups(stars: DataFrame, members: DataFrame) -> DataFrame:
    """Bucket members (bucket, node) with their group's least node."""
    found = stars.select(F.col("a").alias("node"), F.col("b").alias("g"))
    return members.select("bucket", "node").join(found, "node", "left").withColumn("g", F.coalesce("g", "node"))


def _open(members: DataFrame) -> DataFrame:
    """Members of buckets that hold several groups."""
    several = members.groupBy("bucket").agg(F.min("g").alias("x"), F.max("g").alias("y")).filter("x != y")
    return members.join(several.select("bucket"), "bucket", "left_semi")


def _star(members: DataFrame, turn: int) -> DataFrame:
    """One pair for each node: with the leader of one of its buckets that is in another group."""
    key = F.struct(F.xxhash64("node", F.lit(turn)).alias("r"), "node", "g")
    leader = members.groupBy("bucket").agg(F.min(key).alias("l")).select("bucket", "l.*")
    leader = leader.select("bucket", F.col("node").alias("leader"), F.col("g").alias("lg"), "r")
    pairs = members.join(leader, "bucket").filter("g != lg")
    best = pairs.groupBy("node").agg(F.min(F.struct("r", "leader")).alias("l"))
    return best.select(F.least("node", "l.leader").alias("a"), F.greatest("node", "l.leader").alias("b")).distinct()


def links_between(
    groups: np.ndarray, sets: list[tuple[np.ndarray, np.ndarray]], side: np.ndarray | None, least: float
) -> list[tuple[int, int]]:
    """Pairs of rows similar enough that join two groups; with sides, only pairs of rows of different sides.

    The share of a row's weight that lies on another row's shingles bounds their similarity, and gives it where no
    shingle repeats; the rest is worked out pair by pair.
    """
    n = len(sets)
    row = np.repeat(np.arange(n), [len(x) for x, _ in sets])
    shingle, column, count = np.unique(np.concatenate([x for x, _ in sets]), return_inverse=True, return_counts=True)
    weight = np.concatenate([w for _, w in sets]).astype(np.float64)
    total = np.bincount(row, weight, n)
    shared = count[column] > 1
    number = np.cumsum(count > 1) - 1
    row, column, weight = row[shared], number[column[shared]], weight[shared]
    order = np.argsort(column, kind="stable")
    row, column, weight = row[order], column[order], weight[order]
    mass = np.zeros((n, n))
    for at in range(0, int((count > 1).sum()), COLUMNS):
        low, high = np.searchsorted(column, [at, at + COLUMNS])
        r, c = row[low:high], column[low:high] - at
        width = int(c.max()) + 1 if len(c) else 0
        own, there = np.zeros((n, width), np.float32), np.zeros((n, width), np.float32)
        own[r, c] = weight[low:high]
        there[r, c] = 1
        mass += own @ there.T
    mass /= total[:, None]
    possible = np.triu(np.minimum(mass, mass.T) >= least - 1e-5, 1) & (groups[:, None] != groups[None, :])
    if side is not None:
        possible &= side[:, None] != side[None, :]
    unit = np.array([int(w.max()) == 1 for _, w in sets])
    root = {g: g for g in groups.tolist()}

    def find(g: int) -> int:
        while root[g] != g:
            root[g] = g = root[root[g]]
        return g

    found = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(possible)), strict=True):
        a, b = find(groups[i].item()), find(groups[j].item())
        if a == b:
            continue
        if unit[i] and unit[j]:
            both = round(mass[i, j] * total[i])
            good = both >= least * (total[i] + total[j] - both) - 1e-9
        else:
            good = similarity(*sets[i], *sets[j]) >= least
        if good:
            root[b] = a
            found.append((i, j))
    return found


def _rest(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links between different groups that share a bucket, from blocks of buckets."""
    sizes = members.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    rows = members.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    # a block meets itself and every other one, the smaller number first
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", "node", "g", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    held = sets.withColumn("size", F.octet_length("shingles") + F.octet_length("weights"))
    total = rows.join(held.select("node", "size"), "node").agg(F.sum("size")).first()[0] or 0
    parts = max(256, -(-total // GROUP_BYTES))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(parts)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        opened = {n: (unpack(s), np.frombuffer(w, np.uint32)) for n, s, w in zip(part.node, part.shingles, part.weights, strict=True)}
        for (_, i, j), group in part.groupby(["bucket", "i", "j"], sort=False):
            node = group.node.to_numpy()
            side = None if i == j else (group.block == i).to_numpy()
            found = links_between(group.g.to_numpy(), [opened[n] for n in node.tolist()], side, least)
            out += [(min(node[x], node[y]), max(node[x], node[y])) for x, y in found]
        return pd.DataFrame(sorted(set(out)), columns=["a", "b"], dtype="int64")

    return rows.join(sets, "node").groupBy("part").applyInPandas(run, "a long, b long")


def classes(df: DataFrame, id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """Per row its id, ``node`` (null without words), ``class_id`` and ``root``.

    ``class_id`` is the least id of a class: a label, which classes with null or repeated ids share. ``root``, a node of
    the class, tells all classes apart; rows without words have none.
    """
    small_batches(df.sparkSession)
    rows = inputs(df, id=id, text=text)
    signed = stored(_signed(rows))
    per_node = signed.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.any_value("bands").alias("bands"))
    exploded = per_node.select("node", F.explode("bands").alias("bucket")).withColumn("g", F.col("node"))
    members = stored(_open(exploded))
    ids = signed.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"))
    # one row for each node: rows that share an id, or have none, do not meet each other's nodes
    ones = signed.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("id", "told")).alias("one"))
    wanted = members.select("node").distinct().join(ones, "node")
    sets = stored(_sets(rows, wanted))
    stars = None
    for turn in range(STARS + 1):
        if members.isEmpty():
            break
        last = turn == STARS
        found = stored(_rest(members, sets, least) if last else _verified(_star(members, turn), sets, least))
        # the groups so far are stars, to which only the new links are added
        stars = components(found if stars is None else stars.unionByName(found))
        if not last:
            members = stored(_open(_groups(stars, members)))
    named = ids.select("node", F.col("id").alias("class_id"), F.col("node").alias("root"))
    if stars is not None:
        group = stars.select(F.col("a").alias("node"), F.col("b").alias("g"))
        grouped = ids.join(group, "node", "left").withColumn("g", F.coalesce("g", "node"))
        first = grouped.groupBy("g").agg(F.min("id").alias("class_id"))
        named = grouped.join(first, "g").select("node", "class_id", F.col("g").alias("root"))
    out = signed.select("id", "node").join(named, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id"))
    return out.select(F.col("id").alias(id), "node", own.alias("class_id"), "root")


def with_nodes(df: DataFrame, text: str = "text", node: str = "node") -> DataFrame:
    """The whole rows and their node."""
    small_batches(df.sparkSession)
    rows = df.select(column(df, text).alias("text"), F.struct(*[column(df, c) for c in df.columns]).alias("rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, BATCH_BYTES):
            hashes, starts = normal_words(batch.column(0))
            own = pa.array(nodes(hashes, starts), mask=np.diff(starts) == 0)
            yield pa.RecordBatch.from_arrays([batch.column(1), own], ["rest", "own"])

    found = rows.mapInArrow(run, f"rest {rows.schema['rest'].dataType.simpleString()}, own long")
    return found.select("rest.*", F.col("own").alias(node))
