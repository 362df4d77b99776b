"""Removal of repeated word windows, found by level-wise doubling.

Only windows that repeat at one length are extended to twice that length: windows of 5 words that occur twice
anywhere make candidates of 10, those that occur twice make candidates of 20, and so on up to the length asked
for or until no candidates survive. Each level sends the distinct candidates of every chunk of documents, packed, and
gets back one bit for each. The shorter lengths only sift and use as many hash bits as leave 1 in 100 by chance; the
last uses 64 bits.

Documents are ordered by id (null first), then text; of repeated rows one counts as earlier. Null and empty
texts have no words. Words are runs of anything but ASCII blanks, compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakestrata.llm.chunks import ASKED, Chunks, answer, ask, chunked, heard, joined, visit
from lakestrata.llm.hashing import BLANKS, windows
from lakestrata.llm.hashing import words as find_words

SHORTEST = 5


def lengths(words: int, shortest: int = SHORTEST) -> list[int]:
    """The lengths of the levels: halves of the last one (rounded up) down to ``shortest``, ascending."""
    found = [words]
    while found[0] > shortest:
        found.insert(0, -(-found[0] // 2))
    return found


class _Level:
    """Candidates of one chunk at one length: places, and their distinct hashes without ``drop_bits`` low bits."""

    def __init__(self, full: np.ndarray, places: np.ndarray, drop_bits: int):
        self.places = places
        found = full[places]
        if drop_bits:
            found = found >> np.uint64(drop_bits) << np.uint64(drop_bits)
        self.values, self.of, counts = np.unique(found, return_inverse=True, return_counts=True)
        self.several = counts > 1

    def spread(self, marks: np.ndarray, size: int) -> np.ndarray:
        """A mark for each word of the chunk from one for each distinct hash."""
        out = np.zeros(size, bool)
        out[self.places] = marks[self.of]
        return out

    def again(self) -> np.ndarray:
        """Candidates that are not the first of their hash in the chunk."""
        first = np.full(len(self.values), len(self.places))
        np.minimum.at(first, self.of, np.arange(len(self.places)))
        out = np.ones(len(self.places), bool)
        out[first] = False
        return out


def _levels(texts: pa.Array, sizes: list[int], replies: dict, buckets: int, drops: list[int]):
    """The chunk's words per document, its level for the last of ``sizes``, and its number of words."""
    data, starts = joined(texts, b" ")
    begins, _, hashes = find_words(data, BLANKS)
    doc_words = np.diff(np.searchsorted(begins, starts))
    room = np.repeat(np.cumsum(doc_words), doc_words) - np.arange(len(hashes))
    allowed, shorter = None, 0
    for k, length in enumerate(sizes):
        full = windows(hashes, length)
        ok = room[: len(full)] >= length
        if allowed is not None:
            ok &= allowed[: len(full)] & allowed[length - shorter : length - shorter + len(full)]
        level = _Level(full, np.flatnonzero(ok), drops[k])
        if k + 1 < len(sizes):
            again = level.several | heard(replies, length, level.values, buckets)
            allowed, shorter = level.spread(again, len(hashes)), length
    return doc_words, level, len(hashes)


def _ask(chunks: Chunks, sizes: list[int], replies: DataFrame | None, drops: list[int]) -> DataFrame:
    buckets = chunks.buckets

    def run(chunk, ids, texts, rest, heard_before) -> Iterator[pa.RecordBatch]:
        _, level, _ = _levels(texts, sizes, heard_before, buckets, drops)
        yield from ask(chunk, sizes[-1], level.values, buckets, drops[len(sizes) - 1])

    return answer(visit(chunks, replies, run, ASKED), earlier=not drops[len(sizes) - 1])


def remove_repeats(
    df: DataFrame, id: str = "doc_id", text: str = "text", words: int = 20, carry: bool = False
) -> DataFrame:
    """Per row its id, ``n_words``, ``n_removed`` and ``kept`` (the words left, joined by one blank).

    A word goes when a window of ``words`` words that covers it also starts earlier, in an earlier document or
    further ahead in its own. ``carry`` adds the whole input row as ``rest``.
    """
    chunks = chunked(df, id, text, carry)
    buckets, sizes = chunks.buckets, lengths(words)
    drops = [max(8, 64 - 7 - max(1, chunks.text_bytes).bit_length())] * (len(sizes) - 1) + [0]
    replies = None
    for k in range(1, len(sizes) + 1):
        found = _ask(chunks, sizes[:k], replies, drops)
        replies = found if replies is None else replies.unionByName(found)

    def run(chunk, ids, texts, rest, heard_before) -> Iterator[pa.RecordBatch]:
        doc_words, level, size = _levels(texts, sizes, heard_before, buckets, drops)
        marks = heard(heard_before, sizes[-1], level.values, buckets)[level.of]
        starts = level.places[marks | level.again()]
        change = np.zeros(size + words + 1, np.int64)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + words, -1)
        kept = np.cumsum(change)[:size] == 0
        ends = np.cumsum(doc_words)
        left = []
        for text_, a, b in zip(texts, ends - doc_words, ends, strict=True):
            found = (text_.as_buffer().to_pybytes() if text_.is_valid else b"").split()
            left.append(b" ".join([w for w, k in zip(found, kept[a:b].tolist(), strict=True) if k]))
        gone = np.add.reduceat(np.append(~kept, False).astype(np.int64), np.minimum(ends - doc_words, size)) if len(ends) else ends
        gone = np.where(doc_words > 0, gone, 0)
        arrays = [ids, pa.array(doc_words, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())]
        names = ["id", "n_words", "n_removed", "kept"]
        yield pa.RecordBatch.from_arrays([*arrays, rest] if carry else arrays, [*names, "rest"] if carry else names)

    schema = f"id {chunks.kinds['id']}, n_words long, n_removed long, kept string"
    if carry:
        schema += f", rest {chunks.kinds['rest']}"
    return visit(chunks, replies, run, schema, rest=carry).withColumnRenamed("id", id)
