"""Nearest vectors by inner product over learned partitions.

A sample of vectors is joined to its nearest ones, and that graph is cut into parts of nearly equal size with few edges
between them. A small network learns, from a vector, the parts its neighbours lie in. Every row of the table is
indexed under its most probable part; a query looks into several of its most probable parts and ranks what it finds
there by exact inner products. It visits as many parts as found ``RECALL`` of the neighbours of sample vectors that
were held out of the graph and the training, and more where these hold fewer than k other ids.

The model is fitted on at most ``SAMPLE`` vectors, chosen by a hash of their ids, on the driver. There are ``PARTS``
parts or, in large tables, a sixteenth of the square root of the number of rows, with at least ``SAMPLE_PER_PART`` of
the sample each. Vectors without clusters need most of them, whatever their number. Parts are searched in blocks of
rows against blocks of queries, so that a part with very many rows, such as copies of one vector, is many tasks. Scores
are sums of exact products in the order of the components, in double precision.

Vectors that are null, zero, of another length than most of the sample, or that hold null or non-finite components
take no part, nor do null ids. The rows of an id that occurs several times count as one with its best score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakestrata.llm.frames import inputs, small_batches, stored

SAMPLE = 6144
PARTS = 16
SAMPLE_PER_PART = 96
HELD_OUT = 6
RECALL = 0.95
DEGREE = 16
HIDDEN = 128
#: Vectors of a block if they have up to 64 components, else fewer.
BLOCK_ROWS = 32768
BLOCK_QUERIES = 8192


@dataclass
class Router:
    """Probabilities of the parts for vectors."""

    layers: list[np.ndarray]
    probes: int

    @property
    def parts(self) -> int:
        return self.layers[-1].shape[1]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        hidden = np.maximum(_one(x) @ self.layers[0], 0)
        return _softmax(_one(hidden) @ self.layers[1])

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """All parts from the most probable on; ties to the smaller number."""
        return np.argsort(-self.probabilities(x), axis=1, kind="stable")


def _one(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, np.ones(len(x))])


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, degree: int, block: int = 1024) -> np.ndarray:
    """For each vector the rows with the largest inner products, but itself."""
    out = []
    for at in range(0, len(x), block):
        scores = x[at : at + block] @ x.T
        scores[np.arange(len(scores)), np.arange(at, at + len(scores))] = -np.inf
        out.append(np.argpartition(-scores, degree - 1, axis=1)[:, :degree])
    return np.concatenate(out)


def balanced_parts(graph: np.ndarray, parts: int, rounds: int = 30, slack: float = 0.05, seed: int = 1) -> np.ndarray:
    """Cut a graph into parts of nearly equal size: grown from seeds, then improved by moves to the neighbours' part.

    Nodes with the most to gain move first, and a part takes nodes only while it has room.
    """
    n = len(graph)
    rnd = np.random.default_rng(seed)
    room = int(np.ceil(n / parts * (1 + slack)))
    label = np.full(n, -1)
    queue = [[int(s)] for s in rnd.choice(n, parts, replace=False)]
    size = np.zeros(parts, np.int64)
    spare = iter(rnd.permutation(n).tolist())
    while (label < 0).any():  # every part in turn takes the next node of its front
        for p in range(parts):
            if size[p] >= -(-n // parts):
                continue
            node = next((v for v in iter(lambda q=queue[p]: q.pop(0) if q else None, None) if label[v] < 0), None)
            if node is None:
                node = next((v for v in spare if label[v] < 0), None)
            if node is None:
                break
            label[node] = p
            size[p] += 1
            queue[p].extend(v for v in graph[node].tolist() if label[v] < 0)
        else:
            continue
        break
    back = np.concatenate([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])
    node = np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()])
    for _ in range(rounds):
        votes = np.bincount(node * parts + label[back], minlength=n * parts).reshape(n, parts)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), label]
        moved = 0
        for v in np.argsort(-gain, kind="stable").tolist():
            if gain[v] <= 0:
                break
            if size[best[v]] < room:
                size[label[v]] -= 1
                size[best[v]] += 1
                label[v] = best[v]
                moved += 1
        if moved < n // 1000 + 1:
            break
    return label


def train(x: np.ndarray, target: np.ndarray, steps: int = 300, rate: float = 0.01, seed: int = 2) -> list[np.ndarray]:
    """A network with one hidden layer that predicts distributions over parts, by Adam on batches."""
    rnd = np.random.default_rng(seed)
    shapes = [(x.shape[1] + 1, HIDDEN), (HIDDEN + 1, target.shape[1])]
    layers = [rnd.normal(0, np.sqrt(2 / s[0]), s) for s in shapes]
    mean, square = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    for step in range(1, steps + 1):
        pick = rnd.integers(0, len(x), min(1024, len(x)))
        a = _one(x[pick])
        h = np.maximum(a @ layers[0], 0)
        error = (_softmax(_one(h) @ layers[1]) - target[pick]) / len(pick)
        back = (error @ layers[1][:-1].T) * (h > 0)
        for i, g in enumerate((a.T @ back, _one(h).T @ error)):
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.999 * square[i] + 0.001 * g * g
            move = mean[i] / (1 - 0.9**step) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
            layers[i] = layers[i] - rate * (1 - step / (steps + 1)) * move
    return layers


def fit(x: np.ndarray, parts: int, k: int, recall: float = RECALL) -> Router:
    """A router over ``parts``, and how many of them a query must visit to find ``recall`` of its k nearest.

    One in ``HELD_OUT`` vectors takes no part in graph and training: what they must visit to find their nearest among
    all of ``x`` is what other queries must.
    """
    held = np.arange(len(x)) % HELD_OUT == 0
    known = x[~held]
    if parts < 2 or len(known) <= max(k, DEGREE):
        return Router([np.zeros((x.shape[1] + 1, 1)), np.zeros((2, 1))], 1)
    graph = neighbour_graph(known, max(k, DEGREE))
    label = balanced_parts(graph, parts)
    target = np.zeros((len(known), parts))
    np.add.at(target, (np.repeat(np.arange(len(known)), graph.shape[1]), label[graph].ravel()), 1)
    target[np.arange(len(known)), label] += graph.shape[1] / 2
    unit = known / np.linalg.norm(known, axis=1, keepdims=True)
    router = Router(train(unit, target / target.sum(axis=1, keepdims=True)), parts)
    order = router.ranked(x)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(parts), order.shape), axis=1)
    nearest = neighbour_graph(x, k)[held]
    needed = np.sort(np.take_along_axis(place[held], order[:, 0][nearest], axis=1).ravel())
    router.probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1
    return router


def visited(order: np.ndarray, ids: np.ndarray, probes: int, k: int) -> np.ndarray:
    """How many parts each query visits: ``probes``, or more until they hold k ids and the query's own, or all parts."""
    enough = np.cumsum(ids[order], axis=1) > k
    return np.maximum(probes, np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, order.shape[1]))


def usable(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part, whatever their length."""
    rows = inputs(df, id=id, v=vector).filter("id IS NOT NULL AND v IS NOT NULL")
    rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.filter(~bad & F.exists("v", lambda c: c != 0))


def nearest(
    df: DataFrame,
    queries: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    sample: int = SAMPLE,
    parts: int | None = None,
    recall: float = RECALL,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found for each row of ``queries``, but its own id."""
    spark = df.sparkSession
    small_batches(spark)
    rows, asked = usable(df, id, vector), usable(queries, id, vector)
    size = rows.count()
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"query_id {kind}, rank int, vec_id {kind}, score double"
    chosen = [r.v for r in rows.orderBy(F.xxhash64("id"), "id", "v").limit(sample).select("v").collect()]
    if not chosen:
        return spark.createDataFrame([], schema)
    width = int(np.bincount([len(v) for v in chosen]).argmax())
    x = np.array([v for v in chosen if len(v) == width])
    router = fit(x, min(parts or max(PARTS, math.isqrt(size) // 16), max(1, len(x) // SAMPLE_PER_PART)), k, recall)
    model = spark.sparkContext.broadcast(router)

    def route(ids: np.ndarray | None):
        """The most probable part alone or, with the numbers of ids in the parts, all that a query visits."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    order = model.value.ranked(v).astype(np.int32)
                    many = np.ones(len(order), int) if ids is None else visited(order, ids, model.value.probes, k)
                    found = [row[:n] for row, n in zip(order, many, strict=True)]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], ["id", "v", "parts"])

        return run

    routed = f"id {kind}, v array<double>, parts array<int>"
    # equal rows would fill blocks and crowd out others
    indexed = stored(rows.filter(F.size("v") == width).distinct().mapInArrow(route(None), routed).select("id", "v", F.col("parts")[0].alias("part")))
    # an id whose vectors lie in several parts is counted in one of them
    ids = _counts(indexed.groupBy("id").agg(F.min("part").alias("part")), router.parts)
    sent = asked.filter(F.size("v") == width).distinct().mapInArrow(route(np.array(ids)), routed)
    sent = stored(sent.select("id", "v", F.explode("parts").alias("part")))
    blocks, turns = (
        [-(-n // max(1, most * 64 // max(64, width))) for n in _counts(t, router.parts)]
        for t, most in ((indexed, BLOCK_ROWS), (sent, BLOCK_QUERIES))
    )

    def cut(table: DataFrame, own: str, own_counts: list[int], other: str, other_counts: list[int]) -> DataFrame:
        of = lambda counts: F.element_at(F.array(*map(F.lit, counts)), F.col("part") + 1)
        mine = F.pmod(F.xxhash64("id", "v"), of(own_counts)).cast("int").alias(own)
        return table.filter(of(other_counts) > 0).select("*", mine, F.explode(F.sequence(F.lit(0), of(other_counts) - 1)).alias(other))

    left = cut(indexed, "block", blocks, "turn", turns)
    right = cut(sent, "turn", turns, "block", blocks)
    key = ["part", "block", "turn"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_ranker(k), f"query_id {kind}, vec_id {kind}, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _counts(table: DataFrame, parts: int) -> list[int]:
    """How many rows each part has."""
    counts = {r.part: r["count"] for r in table.groupBy("part").count().collect()}
    return [counts.get(p, 0) for p in range(parts)]


def exact_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in the order of the components whatever the number of rows."""
    total = np.zeros(len(x))
    for i in range(x.shape[1]):
        total += x[:, i] * y[:, i]
    return total


def _ranker(k: int):
    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": asked["id"][:0], "vec_id": rows["id"][:0], "score": np.zeros(0)})
        x, q = np.array(rows.v.tolist()), np.array(asked.v.tolist())
        ids, query_ids = rows["id"].to_numpy(), asked["id"].to_numpy()
        number, distinct = pd.factorize(ids)
        by_id = np.argsort(number, kind="stable")
        starts = np.searchsorted(number[by_id], np.arange(len(distinct)))
        out = []
        for at in range(0, len(q), 256):
            part, names = q[at : at + 256], query_ids[at : at + 256]
            scores = part @ x.T
            scores[names[:, None] == ids[None, :]] = -np.inf
            # all within rounding of the k-th best id; the exact scores decide
            best = scores if len(distinct) == len(ids) else np.maximum.reduceat(scores[:, by_id], starts, axis=1)
            at_k = max(0, best.shape[1] - k)
            least = np.partition(best, at_k, axis=1)[:, at_k]
            slip = 1e-12 * np.linalg.norm(part, axis=1) * np.linalg.norm(x, axis=1).max()
            i, j = np.nonzero((scores >= (least - slip)[:, None]) & (scores > -np.inf))
            found = pd.DataFrame({"query_id": names[i], "vec_id": ids[j], "score": exact_scores(part[i], x[j])})
            found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
            found = found.drop_duplicates(["query_id", "vec_id"])
            out.append(found.groupby("query_id").head(k))
        return pd.concat(out)

    return run
