"""Byte-level BPE over Arrow batches with the tokenizers library, and its decoding.

The vocabulary is a rank file (base64 of a token's bytes, blank, rank). The library works on strings, so
each byte stands as one printable character; merges follow from the ranks: every split of a token into two
tokens is a merge, tried in the order of the whole token's rank, which is how ranks alone are merged. A
piece that is a token as it stands is taken whole. Ids of neighbouring pieces never merge.

A blank between two other characters always starts a piece, so texts are cut there. Each distinct piece of a batch is
merged by the library once, thousands in one call; texts with other blanks, and segments with characters beyond
U+052F, which versions of Unicode may class differently, go through its own splitting.

Nulls encode like empty texts: no ids, no bytes. Texts are never cut off, and repeated rows stay apart.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from lakestrata.llm.frames import inputs, slices, small_batches

BATCH_BYTES = 2 << 20
#: Distinct segments, and distinct pieces, that a worker remembers between batches.
KEPT_SEGMENTS = 600_000
PIECES_PER_CALL = 20_000
#: Characters that the pattern may class differently in two versions of Unicode; the library judges these itself.
YOUNG = re.compile("[\u0530-\U0010ffff]")
#: A blank that may not start a piece: next to another blank, or at an end.
ODD_BLANK = re.compile(r"^ | $| [\s\x1c-\x1f\x85\u180e\u200b]|[\s\x1c-\x1f\x85\u180e\u200b] ")


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else 256 upwards."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(prints) else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Every pair of tokens whose concatenation is a token, by rank of the result, then of the parts."""
    found = []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = token[:cut], token[cut:]
            if left in ranks and right in ranks:
                found.append((rank, ranks[left], ranks[right], left, right))
    return [pair[3:] for pair in sorted(found)]


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> tuple[Tokenizer, Tokenizer, np.ndarray, np.ndarray]:
    """A tokenizer of texts, one of lines of byte characters, and the bytes of all ids with where each id's start."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    ranks = read_ranks(path)
    characters = byte_characters()
    shown = {token: "".join(characters[b] for b in token) for token in ranks}
    model = models.BPE(
        vocab={shown[token]: rank for token, rank in ranks.items()},
        merges=[(shown[a], shown[b]) for a, b in _merges(ranks)],
        ignore_merges=True,
        cache_capacity=0,
    )
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    lines = Tokenizer(model)
    lines.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
    back = {c: b for b, c in enumerate(characters)}
    tokens = [b""] * (max(ranks.values()) + 1)
    for text, rank in tokenizer.get_vocab().items():
        tokens[rank] = bytes(back[c] for c in text)
    starts = np.zeros(len(tokens) + 1, np.int64)
    np.cumsum([len(t) for t in tokens], out=starts[1:])
    return tokenizer, lines, np.frombuffer(b"".join(tokens), np.uint8), starts


class Coder:
    """Encodes and decodes texts of one vocabulary; remembers the ids of recent segments."""

    def __init__(self, path: str, pattern: str):
        self.tokenizer, self.lines, self.bytes, self.starts = load(path, pattern)
        self.pattern = regex.compile(pattern)
        self.shown_bytes = {b: c for b, c in enumerate(byte_characters())} | {0xFF: "\n"}
        self.decimals = list(map(str, range(len(self.starts) - 1)))
        self.known: dict[str, bytes] = {}  # ids of a segment, by the segment without its blank
        self.pieces_known: dict[str, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def learn(self, segments: list[str]) -> None:
        """Encode segments that follow a blank: cut them into pieces, and merge each distinct piece once."""
        if not segments:
            return
        text = f" {' '.join(segments)}"
        if YOUNG.search(text):
            young = [s for s in segments if YOUNG.search(s)]
            self.known.update((s, self.whole(f" {s}").tobytes()) for s in young)
            self.learn([s for s in segments if not YOUNG.search(s)])
            return
        pieces = self.pattern.findall(text)
        if len(self.pieces_known) > KEPT_SEGMENTS:
            self.pieces_known.clear()
        new = list(set(pieces).difference(self.pieces_known))
        for start in range(0, len(new), PIECES_PER_CALL):
            part = new[start : start + PIECES_PER_CALL]
            coded = [p.encode() for p in part]
            line = b"\xff".join(coded).decode("latin-1").translate(self.shown_bytes)  # no text holds this byte
            ids = np.array(self.lines.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.int32)
            ends = np.cumsum(self.starts[ids + 1] - self.starts[ids])
            cuts = np.searchsorted(ends, np.cumsum(list(map(len, coded)))) + 1
            data = ids.tobytes()
            self.pieces_known.update(
                zip(part, [data[4 * a : 4 * b] for a, b in pairwise([0, *cuts.tolist()])], strict=True)
            )
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        cuts = np.searchsorted(ends, np.cumsum([len(s) + 1 for s in segments])) + 1
        coded = list(map(self.pieces_known.__getitem__, pieces))
        joined = [b"".join(coded[a:b]) for a, b in pairwise([0, *cuts.tolist()])]
        self.known.update(zip(segments, joined, strict=True))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        cut = [None if ODD_BLANK.search(text) else text.split(" ") for text in texts]
        first = [parts[0] for parts in cut if parts]
        rest = set(chain.from_iterable(parts[1:] for parts in cut if parts))
        if len(self.known) + len(rest) > KEPT_SEGMENTS:
            self.known.clear()
        self.learn(list(rest.difference(self.known)))
        opened = {f: self.whole(f).tobytes() for f in set(first)}
        for text, parts in zip(texts, cut, strict=True):
            if parts is None:
                yield self.whole(text)
            else:
                yield np.frombuffer(opened[parts[0]] + b"".join(map(self.known.__getitem__, parts[1:])), np.int32)

    def begins(self, ids: np.ndarray) -> np.ndarray:
        """The character each id starts in, which for an id inside a character is that character."""
        sizes = self.starts[ids + 1] - self.starts[ids]
        lead = (np.frombuffer(self.decode(ids), np.uint8) & 0xC0) != 0x80
        return (np.cumsum(lead)[np.cumsum(sizes) - sizes] - 1).astype(np.int32)

    def shown(self, ids: np.ndarray) -> str:
        """The ids as decimals joined by commas."""
        decimals = self.decimals
        return ",".join([decimals[i] for i in ids.tolist()])

    def decode(self, ids: np.ndarray) -> bytes:
        """The ids' bytes; an id outside the vocabulary is an error."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.starts) - 1):
            raise ValueError("id outside the vocabulary")
        begins = self.starts[ids]
        sizes = self.starts[ids + 1] - begins
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.repeat(begins - (ends - sizes), sizes) + np.arange(total)].tobytes()

    def pieces(self, ids: np.ndarray) -> list[str]:
        """The text each id adds; a character whose bytes are split comes with the id that completes it.

        Bytes that are no UTF-8 show as the replacement character.
        """
        import codecs

        reader = codecs.getincrementaldecoder("utf-8")("replace")
        cuts = [0, *np.cumsum(self.starts[ids + 1] - self.starts[ids]).tolist()]
        data = self.decode(ids)
        last = len(ids) - 1
        return [reader.decode(data[a:b], i == last) for i, (a, b) in enumerate(pairwise(cuts))]


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its id, ``ids`` and ``begins`` (the character each id starts in, counted from 0)."""
    small_batches(df.sparkSession)
    rows = inputs(df, id=id, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in slices(batches, 1, BATCH_BYTES):
            found = list(own.encode([t or "" for t in batch.column(1).to_pylist()]))
            arrays = [pa.array(x, pa.list_(pa.int32())) for x in (found, [own.begins(f) for f in found])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", "ids", "begins"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, begins array<int>").withColumnRenamed("id", id)


def decode(df: DataFrame, path: str, pattern: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row its id, the decoded ``bytes`` and the text that each id adds (``pieces``); null ids give none."""
    small_batches(df.sparkSession)
    rows = inputs(df, id=id, ids=ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            found = [np.array(x or [], np.int32) for x in batch.column(1).to_pylist()]
            arrays = [pa.array([own.decode(x) for x in found], pa.binary()), pa.array([own.pieces(x) for x in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", "bytes", "pieces"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, bytes binary, pieces array<string>").withColumnRenamed("id", id)


def round_trip(df: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode in one pass and keep digests only: ``n_tokens``, ``ids_sha256``, ``decoded_sha256``."""
    small_batches(df.sparkSession)
    rows = inputs(df, id=id, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in slices(batches, 1, BATCH_BYTES):
            counts, coded, decoded = [], [], []
            for ids in own.encode([t or "" for t in batch.column(1).to_pylist()]):
                counts.append(len(ids))
                coded.append(hashlib.sha256(own.shown(ids).encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id)
