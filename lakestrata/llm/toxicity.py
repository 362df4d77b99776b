"""Toxicity by a classifier chain: categories one after the other, each told what the earlier ones said.

Each category has a logistic regression over which words a text holds and the probabilities of all earlier
categories. For training, those are predictions for folds the earlier models did not see, so that a model learns how
far its predecessors can be trusted on new texts. The last category is the label itself; earlier ones are labelled
documents that hold one of the category's seed words. A document is toxic from the probability on that gave the best
F1 on held-out folds.

Training uses at most ``ROWS`` labelled documents (by a hash of the id). Each counts by the mean, over its ``SKETCH`` least
shingles, of one over the documents that have the shingle, so that k copies count as one: a wrong label on a text with
many near copies would teach its rare words otherwise. It looks at no more than ``WORDS`` words, those whose share
differs most between labelled sides in smoothed standard deviations, and of these at words with half of the best one's
score; where that is more than ``SURPRISE``, that is enough. Everything else covers all rows.
Words are lower-cased (A-Z) runs of letters, digits and bytes beyond ASCII. Null texts have none, and a text without words
is never toxic. Labels other than
0 and 1, and labels of documents that do not exist, are left out; without labels of both kinds, or where every
word is as frequent on either side, nothing is toxic.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestrata.llm.decontam import normal_words
from lakestrata.llm.frames import column, inputs, slices, small_batches, stored
from lakestrata.llm.minhash import shingles

ROWS = 10_000
WORDS = 256
SURPRISE = 8.0
SKETCH = 16
FOLDS = 3
BATCH_BYTES = 4 << 20

#: Seed words of the categories before the label, common abuse in a few languages.
SEEDS = {
    "insult": "idiot moron imbecile fool dumb stupid clown loser jerk imbécile idiota estúpido dummkopf trottel",
    "contempt": "pathetic worthless useless ridiculous inferior minable inútil patético wertlos erbärmlich",
    "disgust": "disgusting trash garbage scum filth vermin vile ordure basura escoria abschaum dreck",
}
LABEL = "toxic"


@dataclass
class Chain:
    """Fitted models: the words' hashes (sorted), a weight vector for each category, and the threshold."""

    names: list[str]
    words: np.ndarray
    weights: list[np.ndarray]
    threshold: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """A probability for each row and category."""
        said = np.zeros((len(x), 0))
        for w in self.weights:
            said = np.column_stack([said, _probability(np.column_stack([x, said]), w)])
        return said


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25, counts: np.ndarray | None = None) -> np.ndarray:
    """Weights and intercept by Newton's method with a ridge on the weights; a row counts as ``counts`` rows."""
    counts = np.ones(len(x)) if counts is None else counts
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (counts * (p - y)) + penalty * w
        curve = (x * (counts * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x
        step = np.linalg.solve(curve + np.diag(penalty), gradient)
        w = w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-5:
            break
    return w


def fit_chain(
    x: np.ndarray, labels: dict[str, np.ndarray], words: np.ndarray, folds: int = FOLDS, counts: np.ndarray | None = None
) -> Chain:
    """Fit the categories in order; earlier probabilities come from models that did not see the row."""
    counts = np.ones(len(x)) if counts is None else counts
    fold = np.arange(len(x)) % folds
    said = np.zeros((len(x), 0))
    weights = []
    for y in labels.values():
        inputs_ = np.column_stack([x, said])
        out = np.zeros(len(x))
        for f in range(folds):
            out[fold == f] = _probability(inputs_[fold == f], logistic(inputs_[fold != f], y[fold != f], counts=counts[fold != f]))
        weights.append(logistic(inputs_, y, counts=counts))
        said = np.column_stack([said, out])
    return Chain(list(labels), words, weights, best_threshold(said[:, -1], y, counts))


def best_threshold(p: np.ndarray, y: np.ndarray, counts: np.ndarray | None = None) -> float:
    """Between the two predictions where cutting gives the best F1."""
    counts = np.ones(len(p)) if counts is None else counts
    order = np.argsort(-p, kind="stable")
    p, hits, total = p[order], np.cumsum((counts * y)[order]), (counts * y).sum()
    f1 = 2 * hits / (np.cumsum(counts[order]) + (total or 1))
    f1[:-1][p[:-1] == p[1:]] = 0  # rows of one prediction stay together
    k = int(np.argmax(f1))
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0.0)) / 2)


def seed_hashes(words: str) -> np.ndarray:
    return normal_words(pa.array([words]))[0]


def _word_lists(df: DataFrame) -> DataFrame:
    """The distinct words and the least shingles (as hashes) of each row of (id, label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, BATCH_BYTES):
            hashes, starts = normal_words(batch.column(2))
            words = [np.unique(hashes[a:b]).astype(np.int64) for a, b in zip(starts, starts[1:], strict=False)]
            text, shingle, _ = shingles(hashes, starts)  # in order within each text
            cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
            least = [shingle[a : min(b, a + SKETCH)].astype(np.int64) for a, b in zip(cut, cut[1:], strict=False)]
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (words, least)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["id", "label", "words", "sketch"])

    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(run, f"id {kind}, label int, words array<long>, sketch array<long>")


def _weighted(lists: DataFrame) -> DataFrame:
    """The rows (of a bounded sample) with their ``weight``, whose sums are exact in any order."""
    rows = stored(lists.withColumn("row", F.monotonically_increasing_id()))
    sketches = rows.select("row", "sketch").collect()
    copies = Counter(shingle for r in sketches for shingle in r.sketch)
    weights = [(r.row, round(np.mean([1 / copies[x] for x in r.sketch] or [1.0]) * (1 << 20)) / (1 << 20)) for r in sketches]
    return rows.join(F.broadcast(lists.sparkSession.createDataFrame(weights, "row long, weight double")), "row")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = LABEL,
    seeds: dict[str, str] | None = None,
    rows: int = ROWS,
    words: int = WORDS,
) -> Chain | None:
    """A chain for ``label`` and the categories of ``seeds``; none where labels have one side only."""
    small_batches(docs.sparkSession)
    seeds = SEEDS if seeds is None else seeds
    known = inputs(labels, id=id, label=label).filter("label IN (0, 1) AND id IS NOT NULL")
    known = known.select("id", F.col("label").cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("id"), "id", "label").limit(rows)
    texts = inputs(docs, id=id, text=text).join(F.broadcast(sample), "id").select("id", "label", "text")
    lists = stored(_weighted(_word_lists(texts)))
    sides = {r.label: r["sum(weight)"] for r in lists.groupBy("label").sum("weight").collect()}
    if set(sides) != {0, 1}:
        return None
    share = F.lit(sides[1] / (sides[0] + sides[1]))
    counts = lists.select("label", "weight", F.explode("words").alias("word")).groupBy("word")
    counts = counts.agg(F.sum("weight").alias("n"), F.sum(F.col("label") * F.col("weight")).alias("hits"))
    # words of few documents are held back by the one that is added
    surprise = F.abs(F.col("hits") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) + 1)
    scored = counts.select("word", F.round(surprise, 9).alias("score")).filter("score > 0")
    best = scored.orderBy(F.col("score").desc(), "word").limit(words).collect()
    if not best:
        return None
    bar = min(SURPRISE, best[0].score / 2)
    best = [r for r in best if r.score >= bar]
    vocabulary = np.sort(np.array([r.word for r in best], np.int64).view(np.uint64))
    looked_for = {c: set(seed_hashes(s).astype(np.int64).tolist()) for c, s in seeds.items()}
    wanted = sorted(set(vocabulary.astype(np.int64).tolist()).union(*looked_for.values()))
    # of each sampled row only the words that matter come here
    kept = F.array_intersect("words", F.lit(wanted).cast("array<long>"))
    matrix, y, weight, has = [], [], [], {c: [] for c in seeds}
    for row in lists.select("label", "weight", kept.alias("kept")).orderBy(F.xxhash64("id"), "id", "label").collect():
        matrix.append(np.isin(vocabulary, np.array(row.kept, np.int64).view(np.uint64)).astype(float))
        y.append(row.label)
        weight.append(row.weight)
        for c, hashes in looked_for.items():
            has[c].append(bool(row.label and hashes.intersection(row.kept)))
    x, y = np.array(matrix).reshape(len(y), len(vocabulary)), np.array(y, float)
    targets = {c: np.array(v, float) for c, v in has.items()} | {label: y}
    return fit_chain(x, targets, vocabulary, counts=np.array(weight))


def score(df: DataFrame, chain: Chain | None, id: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """Per row its id, a probability for each category (``p_...``) and ``toxic``; ``carry`` adds the row as ``rest``."""
    small_batches(df.sparkSession)
    rows = df.select(column(df, id).alias("id"), column(df, text).alias("text"))
    if carry:
        rest = F.struct(*[column(df, c) for c in df.columns]).alias("rest")
        rows = df.select(column(df, id).alias("id"), column(df, text).alias("text"), rest)
    names = [f"p_{n}" for n in (chain.names if chain else [*SEEDS, LABEL])]
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, BATCH_BYTES):
            n = batch.num_rows
            if chain is None:
                said, toxic = np.zeros((n, len(names))), np.zeros(n, bool)
            else:
                hashes, starts = normal_words(batch.column(1))
                size = len(chain.words)
                at = np.minimum(np.searchsorted(chain.words, hashes), max(size - 1, 0))
                good = np.flatnonzero(chain.words[at] == hashes) if size else np.zeros(0, np.int64)
                row = np.searchsorted(starts, good, "right") - 1
                x = np.zeros((n, size))
                x[row, at[good]] = 1
                said = chain.predict(x)
                toxic = (said[:, -1] >= chain.threshold) & (np.diff(starts) > 0)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            arrays += [pa.array(said[:, i]) for i in range(len(names))] + [pa.array(toxic)]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, *names, "toxic"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    schema += "".join(f", {n} double" for n in names) + ", toxic boolean"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id)
