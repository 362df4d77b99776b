"""Importance resampling towards a target: documents drawn by hashed word n-grams and Gumbel noise.

A batch's texts are joined with a sentinel between them, and one regex pass finds all words and sentinels. Where the
sentinels stand says which document a word belongs to, so n-grams that would reach into another document are masked
by a sorted search, and what is left is counted by ``bincount``. A feature's bucket is the CRC-32 of its bytes modulo
the number of buckets. Source and target are counted whole; a bucket's gain is the logarithm of how much more
often the target holds it. The drawn documents are those with the highest sum of gains plus noise, which draws without
replacement by importance; the noise follows from a hash of the id, so reruns and retries agree.

Counts are one number for each bucket: that many reach the driver and the executors, whatever the input's size. Ranks
come from a range shuffle of ids and scores and from the sizes of its partitions; no task sees all rows.

Words are lower-cased (A-Z) runs of letters, digits and bytes beyond ASCII; null texts have none and weigh 0. Texts are
never cut off: one longer than a batch is read in pieces that overlap by the words an n-gram needs. Null ids are
hashed as empty ones and come last among equal scores; rows that repeat an id and a text each have a rank of their own.
Fewer rows than a draw asks for, or none, are all drawn.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestrata.llm.frames import column, inputs, slices, small_batches, stored
from lakestrata.llm.hashing import LOWER

BUCKETS = 10_000
LEAST_WORDS = 20
PER_CENT = 10
SEED = 2024
BATCH_BYTES = 2 << 20
#: Checksums of words that a worker remembers between batches.
KEPT_WORDS = 500_000
#: Rows whose order one task of the range shuffle works out.
ROWS_PER_PART = 1_000_000

SENTINEL = b"\x00"
TOKEN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|\x00")
GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Lower case for A-Z; a sentinel inside a text becomes another character between words.
NORMAL = bytes(LOWER).replace(SENTINEL, b" ", 1)


class _Sums(dict):
    """Checksum of each word met so far; a sentinel has none."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = found = -1 if word == SENTINEL else zlib.crc32(word)
        return found


_sums = _Sums()


def features(texts: list[bytes], longest: int, carried: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all n-grams of 1 to ``longest`` words: their texts and checksums; and the number of words of each text.

    N-grams within the first ``carried`` words of the first text, and these words, do not count.
    """
    tokens = TOKEN.findall(SENTINEL.join([t.translate(NORMAL) for t in texts]))
    sums = np.fromiter(map(_sums.__getitem__, tokens), np.int64, len(tokens))
    word = sums >= 0
    borders = np.flatnonzero(~word)
    text = np.searchsorted(borders, np.arange(len(tokens)))
    words = np.bincount(text[word], minlength=len(texts))
    if texts:
        words[0] -= carried
    start = np.flatnonzero(word)
    found = [(start[carried:], sums[start[carried:]])]
    spaced = [b" " + t for t in tokens] if longest > 1 else []
    grown = sums[start]
    for size in range(2, longest + 1):
        end = start + size - 1
        inside = end < len(tokens)
        inside[inside] = word[end[inside]] & (text[end[inside]] == text[start[inside]])
        start, grown = start[inside], grown[inside]
        last = [spaced[i] for i in (start + size - 1).tolist()]
        grown = np.fromiter(map(zlib.crc32, last, grown.tolist()), np.int64, len(start))
        new = start + size > carried
        found.append((start[new], grown[new]))
    at, checksum = (np.concatenate(x) for x in zip(*found, strict=True))
    return text[at], checksum, words


def _pieces(text: bytes, longest: int) -> Iterator[tuple[bytes, int]]:
    """A long text in pieces that end between words, each with the words before it that n-grams need."""
    at, before = 0, []
    while at < len(text):
        gap = GAP.search(text, at + BATCH_BYTES)
        stop = gap.end() if gap else len(text)
        piece = text[at:stop]
        yield b" ".join([*before, piece]), len(before)
        if longest > 1:
            near = before + [t for t in TOKEN.findall(piece.translate(NORMAL)) if t != SENTINEL][-(longest - 1) :]
            before = near[-(longest - 1) :]
        at = stop


def _batches(batch: pa.RecordBatch, of: int, longest: int, buckets: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, their texts' features (row, bucket) and numbers of words; of a long text a piece at a time."""
    for rows in slices(iter([batch]), of, BATCH_BYTES):
        texts = [(t.as_buffer() or b"") if t.is_valid else b"" for t in rows.column(of).cast(pa.binary())]
        texts = [bytes(t) for t in texts]
        short = [t if len(t) <= BATCH_BYTES else b"" for t in texts]
        row, checksum, words = features(short, longest)
        yield rows, row, checksum % buckets, words
        for i, text in enumerate(texts):
            if len(text) > BATCH_BYTES:
                for piece, carried in _pieces(text, longest):
                    _, checksum, words = features([piece], longest, carried)
                    more = np.zeros(len(texts), np.int64)
                    more[i] = words[0]
                    yield rows, np.full(len(checksum), i), checksum % buckets, more


def counted(df: DataFrame, text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How often all texts hold a feature of each bucket."""
    small_batches(df.sparkSession)
    rows = inputs(df, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, bucket, _ in _batches(batch, 0, longest, buckets):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    found = rows.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in found.collect():  # at most one row for each bucket
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of each bucket's share in the target over that in the source, one added to each."""
    more, all_source, all_target = len(source), float(source.sum()), float(target.sum())
    ratio = (target + 1.0) * (all_source + more) / ((source + 1.0) * (all_target + more))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], np.int64)


def noise(id: Column, seed: int = SEED) -> Column:
    """Gumbel noise times 1000, floored, from the first 32 bits of a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.ln(-F.ln(uniform)))


def _scored(df: DataFrame, target: DataFrame, id: str, text: str, longest: int, buckets: int, seed: int, carry: bool) -> DataFrame:
    """The stored rows ``id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``row``, which tells equal ones apart."""
    weights = gains(counted(df, text, longest, buckets), counted(target, "text", longest, buckets))
    small_batches(df.sparkSession)
    rows = inputs(df, id=id, text=text)
    if carry:
        whole = F.struct(*[column(df, c) for c in df.columns])
        rows = df.select(column(df, id).alias("id"), column(df, text).alias("text"), whole.alias("rest"))
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, sums = None, []
            for part, row, bucket, words in _batches(batch, 1, longest, buckets):
                n = part.num_rows
                found = [words, np.bincount(row, minlength=n), np.bincount(row, weights[bucket], n).astype(np.int64)]
                if part is last:
                    sums = [a + b for a, b in zip(sums, found, strict=True)]
                    continue
                if last is not None:
                    yield scored(last, sums)
                last, sums = part, found
            if last is not None:
                yield scored(last, sums)

    def scored(part: pa.RecordBatch, sums: list[np.ndarray]) -> pa.RecordBatch:
        arrays = [part.column(c) for c in kept] + [pa.array(s, pa.int64()) for s in sums]
        return pa.RecordBatch.from_arrays(arrays, [*kept, "n_words", "n_features", "weight"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    found = rows.mapInArrow(run, f"{kinds}, n_words long, n_features long, weight long")
    score = F.col("weight") + noise(F.col("id"), seed)
    return stored(found.select("*", score.alias("score"), F.monotonically_increasing_id().alias("row")))


ORDER = [F.desc, F.asc_nulls_last, F.asc]


def _ranked(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows with their place by score, id and row, from 1, and how many they are."""
    spark = rows.sparkSession
    total = rows.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // ROWS_PER_PART))
    order = [by(c) for by, c in zip(ORDER, ("score", "id", "row"), strict=True)]
    part = F.spark_partition_id().cast("long")
    at = F.monotonically_increasing_id() - F.shiftleft(part, 33)
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered = stored(ordered.select("*", part.alias("part"), at.alias("at")))
    before, offsets = 0, []
    for number, n in sorted(ordered.groupBy("part").count().collect()):  # one row for each partition
        offsets.append((number, before))
        before += n
    offset = spark.createDataFrame(offsets, "part long, before long")
    return ordered.join(F.broadcast(offset), "part").withColumn("rank", F.col("before") + F.col("at") + 1), total


def importance(
    df: DataFrame,
    target: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    longest: int = 1,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    per_cent: int = PER_CENT,
    seed: int = SEED,
) -> DataFrame:
    """Per row its id, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (null if it is not drawn).

    Drawn are ``per_cent`` of 100 of the documents with at least ``least_words`` words. The target's texts are in
    its column ``text``.
    """
    rows = _scored(df, target, id, text, longest, buckets, seed, carry=False)
    whole = F.col("n_words") >= least_words
    ranked, total = _ranked(rows.filter(whole))
    drawn = F.col("rank") <= per_cent * total // 100
    names = [F.col("id").alias(id), "n_words", "n_features", "weight", "score"]
    rest = rows.filter(~whole).select(*names, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*names, F.when(drawn, F.col("rank")).alias("rank")).unionByName(rest)


def draw(
    df: DataFrame,
    target: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    longest: int = 1,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    per_cent: int = PER_CENT,
    seed: int = SEED,
) -> DataFrame:
    """The whole rows that are drawn: the texts lie still while ids and scores are put in order."""
    rows = _scored(df, target, id, text, longest, buckets, seed, carry=True).filter(F.col("n_words") >= least_words)
    ranked, total = _ranked(rows.select("id", "score", "row"))
    last = ranked.filter(F.col("rank") == per_cent * total // 100).select("id", "score", "row").first()
    if last is None:
        return rows.filter(F.lit(False)).select("rest.*")
    if last.id is None:
        before, same = F.col("id").isNotNull(), F.col("id").isNull()
    else:
        before, same = F.coalesce(F.col("id") < last.id, F.lit(False)), F.coalesce(F.col("id") == last.id, F.lit(False))
    level = (F.col("score") == last.score) & (before | (same & (F.col("row") <= last.row)))
    return rows.filter((F.col("score") > last.score) | level).select("rest.*")
