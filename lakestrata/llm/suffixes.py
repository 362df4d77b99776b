"""Removal of byte strings that occur more than once, with a suffix order over chosen places.

Every window of ``length`` bytes has one place that its content alone chooses: the first of its grams whose hash is
least. Equal windows choose the same place, so only suffixes at chosen places (about one in seventy bytes) are
looked at, each with the segment that its windows cover:

1. Chunks of documents send the hash of each place's gram and of its whole segment. Segments that occur twice repeat
   with all their windows; grams that occur once repeat nowhere.
2. Where a gram has several different segments, one segment of each kind goes to the gram's bucket. There the suffixes
   are ordered by deep-shallow sorting: multikey quicksort, eight bytes at a time, to a shallow depth, then a blind
   trie for every group that still shares its prefix. Neighbours in that order share the longest prefixes; going left
   byte by byte splits the order into suffixes with the same left side, and a window repeats where its suffix and a
   neighbour share enough.
3. A gram with more than ``hot`` different segments would make its bucket large. Its segments' windows are asked for
   one by one instead, once per chunk however often they occur, with the same result.

Null and empty texts have no bytes; matches never run from one document into the next; of repeated rows each counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from lakestrata.llm.chunks import (
    REPLIES,
    Chunks,
    chunked,
    cuts,
    joined,
    pack,
    shrink,
    unpack,
    visit,
    widen,
)
from lakestrata.llm.frames import stored
from lakestrata.llm.hashing import byte_sums, mix, span_hashes

BLOCK = 1 << 17
SHALLOW = 128
HOT = 4096

ASKED = "bucket int, chunk long, level int, codes binary, more binary, text binary"
NAMES = ["bucket", "chunk", "level", "codes", "more", "text"]
SEGMENTS, PARTNERS, SINGLE = 0, 1, 2
#: What is known of a segment: nothing repeats; all of it does; ask; all, and others ask; the same for hot grams.
NONE, ALL, ASK, SHOW, ASK_HOT, SHOW_HOT = range(6)


# chosen places


def _sliding(values: np.ndarray, width: int, pick: np.ufunc, beyond: int) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` neighbours, from running ones within blocks."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, beyond, values.dtype)
    padded[: len(values)] = values
    table = padded.reshape(-1, width)
    ahead = pick.accumulate(table, axis=1).ravel()
    behind = pick.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:count], ahead[width - 1 : width - 1 + count])


def _places(block: np.ndarray, valid: np.ndarray, length: int, gram: int):
    """Chosen places of the windows that start at ``valid`` bytes: place, first and last start, hashes."""
    grams = len(block) - gram + 1
    sums = byte_sums(block)
    at = np.arange(grams)
    hashes = span_hashes(sums, at, at + gram)
    width = length - gram + 1
    least = _sliding(hashes, width, np.minimum, (1 << 64) - 1)[: len(valid)]
    least[~valid] = 0
    around = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    around[width - 1 : width - 1 + len(least)] = least
    most = _sliding(around, width, np.maximum, 0)
    chosen = hashes[: len(most)] == most[: len(hashes)]
    places = np.flatnonzero(chosen)
    starts = np.flatnonzero(valid)
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    of = (np.cumsum(chosen) - chosen)[starts]  # the first chosen place from each start on
    wrong = np.flatnonzero(hashes[places[of]] != least[starts])
    while len(wrong):
        of[wrong] += 1
        wrong = wrong[hashes[places[of[wrong]]] != least[starts[wrong]]]
    new = np.append(True, (of[1:] != of[:-1]) | (starts[1:] != starts[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    p, a, b = places[of[first]], starts[first], starts[last]
    shape = mix(((p - a) << 32 | (b - a)).astype(np.uint64))
    # least hashes are small ones: mixed again they spread over all buckets
    return p, a, b, mix(hashes[p]), mix(span_hashes(sums, a, b + length) ^ shape)


class Segments:
    """All chosen places of a chunk, and their distinct (gram, segment) pairs in order."""

    def __init__(self, data: np.ndarray, doc_starts: np.ndarray, length: int, gram: int, drop_bits: int):
        found = []
        for at in range(0, max(0, len(data) - length + 1), BLOCK):
            count = min(BLOCK, len(data) - length + 1 - at)
            valid = np.ones(count, bool)
            low, high = np.searchsorted(doc_starts, [at + 1, at + count + length])
            for end in doc_starts[low:high].tolist():  # windows would run over the end of their document
                valid[max(end - length + 1 - at, 0) : max(end - at, 0)] = False
            p, a, b, h, t = _places(data[at : at + count + length - 1], valid, length, gram)
            found.append((p + at, a + at, b + at, h, t))
        kinds = [np.int64] * 3 + [np.uint64] * 2
        self.place, self.first, self.last, h, t = (
            np.concatenate([f[i] for f in found]) if found else np.zeros(0, k) for i, k in enumerate(kinds)
        )
        h >>= np.uint64(drop_bits)
        order = np.lexsort((t, h))
        h, t = h[order], t[order]
        new = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))[: len(h)]
        self.pair = np.zeros(len(h), np.int64)  # of each place
        self.pair[order] = np.cumsum(new) - 1
        self.example = order[new]  # a place of each pair
        self.gram, self.hash = h[new], t[new]
        self.several = np.diff(np.append(np.flatnonzero(new), len(h))) > 1
        self.drop_bits = drop_bits

    def cuts(self, buckets: int) -> np.ndarray:
        return cuts(self.gram << np.uint64(self.drop_bits), buckets)


# step 1: which segments and grams occur again


def _ask_segments(chunk: int, own: Segments, buckets: int) -> Iterator[pa.RecordBatch]:
    at = own.cuts(buckets)
    rows = [
        (b, chunk, SEGMENTS, pack(own.gram[x:y]), own.hash[x:y].tobytes(), np.packbits(own.several[x:y]).tobytes())
        for b, (x, y) in enumerate(zip(at, at[1:], strict=False))
        if y > x
    ]
    if rows:
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=NAMES), schema=_ARROW, preserve_index=False)


_ARROW = pa.schema(
    [("bucket", pa.int32()), ("chunk", pa.int64()), ("level", pa.int32())]
    + [(n, pa.binary()) for n in ("codes", "more", "text")]
)


def _judge_segments(rows: pd.DataFrame, hot: int) -> list[bytes]:
    grams = [unpack(c) for c in rows.codes]
    sizes = [len(g) for g in grams]
    gram = np.concatenate(grams)
    hashes = np.concatenate([np.frombuffer(m, np.uint64) for m in rows.more])
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(rows.text, sizes, strict=True)])
    order = np.lexsort((hashes, gram))
    gram, hashes = gram[order], hashes[order]
    new_gram = np.append(True, gram[1:] != gram[:-1])
    new = np.append(True, hashes[1:] != hashes[:-1]) | new_gram
    kind = np.cumsum(new) - 1
    again = np.bincount(kind, 1 + several[order])[kind] > 1
    which = np.cumsum(new_gram) - 1
    kinds = np.bincount(which, new)[which]
    show = (kinds > 1) & new
    codes = np.where(again, np.where(show, SHOW, ALL), np.where(kinds > 1, ASK, NONE))
    codes = np.where((kinds > hot) & (codes >= ASK), codes + 2, codes).astype(np.uint8)
    back = np.empty_like(codes)
    back[order] = codes
    return [shrink(x) for x in np.split(back, np.cumsum(sizes)[:-1])]


def _codes(replies: dict, own: Segments, buckets: int) -> np.ndarray:
    at = own.cuts(buckets)
    found = [widen(replies[SEGMENTS, b], np.uint8) for b, (x, y) in enumerate(zip(at, at[1:], strict=False)) if y > x]
    return np.concatenate(found) if found else np.zeros(0, np.uint8)


# step 2: suffixes in order, for grams with several segments


def _show_partners(chunk: int, data: np.ndarray, own: Segments, codes: np.ndarray, length: int, buckets: int):
    at = own.cuts(buckets)
    rows = []
    for b, (x, y) in enumerate(zip(at, at[1:], strict=False)):
        pairs = x + np.flatnonzero((codes[x:y] == ASK) | (codes[x:y] == SHOW))
        if not len(pairs):
            continue
        e = own.example[pairs]
        p, first, last = own.place[e], own.first[e], own.last[e]
        meta = np.stack([p - first, last + length - p, codes[pairs] == ASK]).astype(np.uint16)
        text = b"".join([data[i:j].tobytes() for i, j in zip(first, last + length, strict=True)])
        rows.append((b, chunk, PARTNERS, pack(own.gram[pairs]), meta.tobytes(), shrink(np.frombuffer(text, np.uint8))))
    if rows:
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=NAMES), schema=_ARROW, preserve_index=False)


def multikey_quicksort(words: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order rows of 64-bit words within groups; all open groups are split by a pivot at once, in three.

    Returns the order and, for each place in it, where the rows equal to it in all words begin.
    """
    n, width = words.shape
    order = np.argsort(groups, kind="stable")
    new = np.append(True, groups[order][1:] != groups[order][:-1])[:n]
    depth = np.zeros(n, np.int64)
    while True:
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, n))
        group = np.repeat(starts, size)
        open_ = np.flatnonzero((np.repeat(size, size) > 1) & (depth < width))
        if not len(open_):
            return order, group
        middle = order[group[open_] + np.repeat(size, size)[open_] // 2]
        mine, pivot = words[order[open_], depth[open_]], words[middle, depth[open_]]
        side = (mine > pivot).astype(np.int64) + (mine >= pivot)
        key = group[open_] * 3 + side
        turn = np.argsort(key, kind="stable")
        order[open_] = order[open_][turn]
        depth[open_] += (side == 1)[turn]
        key = key[turn]
        new[open_] |= np.append(True, key[1:] != key[:-1])


class BlindTrie:
    """Orders strings by the few characters in which they branch; the rest is compared once, with one leaf."""

    def __init__(self) -> None:
        self.root = None

    def add(self, string: bytes, item: int) -> None:
        if self.root is None:
            self.root = (string, [item])
            return
        node = self.root
        while isinstance(node, _Branch):
            branch = string[node.depth] if node.depth < len(string) else -1
            node = node.next.get(branch) or next(iter(node.next.values()))
        leaf = node[0]
        if leaf == string:
            node[1].append(item)
            return
        low, high = 0, min(len(leaf), len(string))  # length of the common prefix
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if leaf[:middle] == string[:middle] else (low, middle - 1)
        mine, other = (s[low] if low < len(s) else -1 for s in (string, leaf))
        above, node = None, self.root
        while isinstance(node, _Branch) and node.depth < low:
            above, key = node, string[node.depth] if node.depth < len(string) else -1
            node = node.next[key]
        if isinstance(node, _Branch) and node.depth == low:
            node.next[mine] = (string, [item])
            return
        branch = _Branch(low, {other: node, mine: (string, [item])})
        if above is None:
            self.root = branch
        else:
            above.next[key] = branch

    def items(self) -> Iterator[int]:
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, _Branch):
                stack.extend(node.next[c] for c in sorted(node.next, reverse=True))
            else:
                yield from node[1]


class _Branch:
    def __init__(self, depth: int, next: dict):
        self.depth, self.next = depth, next


def deep_shallow(strings: np.ndarray, sizes: np.ndarray, groups: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """The order of zero-padded strings within groups: a quicksort to a shallow depth, then blind tries."""
    shallow = min(shallow, strings.shape[1]) // 8 * 8
    words = np.ascontiguousarray(strings[:, :shallow]).view(">u8").astype(np.uint64)
    order, same = multikey_quicksort(words.reshape(len(strings), -1), groups)
    starts = np.flatnonzero(np.append(True, same[1:] != same[:-1])[: len(same)])
    for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(same)], strict=True):
        if y - x > 1:
            trie = BlindTrie()
            for i in order[x:y].tolist():
                trie.add(strings[i, min(shallow, sizes[i]) : sizes[i]].tobytes(), i)
            order[x:y] = list(trie.items())
    return order


def repeats(left: np.ndarray, left_size, right: np.ndarray, right_size, groups, length: int, shallow: int = SHALLOW):
    """For each suffix and each number of bytes left of it: does that window occur in another segment too?

    ``left`` holds the bytes before each place, nearest first, ``right`` those from it on.
    """
    n = len(right)
    order = deep_shallow(right, right_size, groups, shallow)
    left, left_size, right, right_size, groups = (x[order] for x in (left, left_size, right, right_size, groups))
    unequal = right[1:] != right[:-1]
    shared = np.where(unequal.any(axis=1), unequal.argmax(axis=1), right.shape[1])
    shared = np.minimum(shared, np.minimum(right_size[1:], right_size[:-1]))
    shared = np.where(groups[1:] == groups[:-1], shared, 0).astype(np.int32)
    tables = [shared]  # least of 1, 2, 4 ... neighbours
    while len(tables[-1]) > 1 << (len(tables) - 1):
        step = 1 << (len(tables) - 1)
        tables.append(np.minimum(tables[-1][:-step], tables[-1][step:]))
    out = np.zeros((n, left.shape[1] + 1), bool)
    rows = np.arange(n)
    cell = np.cumsum(np.append(True, groups[1:] != groups[:-1])[:n])
    for back in range(left.shape[1] + 1):
        if back:
            far = left_size[rows] >= back
            rows, cell = rows[far], cell[far]
            key = cell * 256 + left[rows, back - 1]
            turn = np.argsort(key, kind="stable")
            rows, key = rows[turn], key[turn]
            cell = np.cumsum(np.append(True, key[1:] != key[:-1])[: len(key)])
        same = cell[1:] == cell[:-1]
        pad = np.zeros(1, bool)
        some = np.append(pad, same)[: len(rows)] | np.append(same, pad)[: len(rows)]
        rows, cell = rows[some], cell[some]
        if not len(rows):
            break
        gap = rows[1:] - rows[:-1]
        common = np.zeros(len(gap), np.int32)
        near = np.flatnonzero((cell[1:] == cell[:-1]) & (gap > 0))
        power = np.frexp(gap[near])[1] - 1
        for k in np.unique(power):
            i = near[power == k]
            common[i] = np.minimum(tables[k][rows[i]], tables[k][rows[i + 1] - (1 << k)])
        best = np.maximum(np.append(0, common), np.append(common, 0))
        out[rows, back] = best >= length - back
    result = np.empty_like(out)
    result[order] = out
    return result


def _judge_partners(rows: pd.DataFrame, length: int, gram: int) -> list[bytes]:
    grams = [unpack(c) for c in rows.codes]
    sizes = [len(g) for g in grams]
    metas = [np.frombuffer(m, np.uint16).reshape(3, -1).astype(np.int64) for m in rows.more]
    before, after, asks = np.concatenate(metas, axis=1)
    data = np.concatenate([widen(t, np.uint8) for t in rows.text])
    starts = np.cumsum(before + after) - before - after
    n = len(before)
    left, right = np.zeros((n, length - gram), np.uint8), np.zeros((n, length), np.uint8)
    for i, (s, x, y) in enumerate(zip(starts.tolist(), before.tolist(), after.tolist(), strict=True)):
        left[i, :x] = data[s : s + x][::-1]
        right[i, :y] = data[s + x : s + x + y]
    found = repeats(left, before, right, after, np.concatenate(grams).astype(np.int64), length)
    parts = np.split(np.arange(n), np.cumsum(sizes)[:-1])
    return [shrink(np.packbits(found[p][asks[p] > 0])) for p in parts]


# step 3: windows of hot grams, one by one


class _Single:
    """The distinct windows of a chunk's segments with hot grams."""

    def __init__(self, data: np.ndarray, own: Segments, codes: np.ndarray, length: int):
        places = np.flatnonzero(codes[own.pair] >= ASK_HOT)
        first, last = own.first[places], own.last[places]
        count = last - first + 1
        self.starts = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        hashes = np.zeros(len(self.starts), np.uint64)
        block = self.starts // BLOCK
        for k in np.unique(block):
            i = np.flatnonzero(block == k)
            sums = byte_sums(data[k * BLOCK : (k + 1) * BLOCK + length])
            at = self.starts[i] - k * BLOCK
            hashes[i] = span_hashes(sums, at, at + length)
        self.values, self.of, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        self.several = counts > 1

    def ask(self, chunk: int, buckets: int) -> Iterator[pa.RecordBatch]:
        at = cuts(self.values, buckets)
        rows = [
            (b, chunk, SINGLE, pack(self.values[x:y]), None, None)
            for b, (x, y) in enumerate(zip(at, at[1:], strict=False))
            if y > x
        ]
        if rows:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=NAMES), schema=_ARROW, preserve_index=False)

    def heard(self, replies: dict, buckets: int) -> np.ndarray:
        at = cuts(self.values, buckets)
        parts = [
            np.unpackbits(np.frombuffer(replies[SINGLE, b], np.uint8), count=y - x)
            for b, (x, y) in enumerate(zip(at, at[1:], strict=False))
            if y > x
        ]
        return self.starts[(self.several | np.concatenate(parts).astype(bool))[self.of]] if parts else self.starts


def _judge_single(rows: pd.DataFrame) -> list[bytes]:
    lists = [unpack(c) for c in rows.codes]
    values = np.concatenate(lists)
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    bits = np.zeros(len(values), bool)
    bits[order[1:]] = same
    bits[order[:-1]] |= same
    return [np.packbits(x).tobytes() for x in np.split(bits, np.cumsum([len(x) for x in lists])[:-1])]


# the operator


def _replies(asked: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        level = rows.level.iloc[0]
        if level == SEGMENTS:
            rows["bits"] = _judge_segments(rows, hot)
        elif level == PARTNERS:
            rows["bits"] = _judge_partners(rows, length, gram)
        else:
            rows["bits"] = _judge_single(rows)
        return rows[["chunk", "level", "bucket", "bits"]]

    return stored(asked.groupBy("bucket", "level").applyInPandas(run, REPLIES))


def _repeated(data, own: Segments, replies: dict, length: int, gram: int, buckets: int) -> np.ndarray:
    """Which bytes of a chunk a repeated window covers."""
    codes = _codes(replies, own, buckets)
    change = np.zeros(len(data) + 1, np.int32)
    whole = np.flatnonzero(np.isin(codes[own.pair], (ALL, SHOW, SHOW_HOT)))
    starts = [own.first[whole]]
    ends = [own.last[whole] + length]
    at = own.cuts(buckets)
    for b, (x, y) in enumerate(zip(at, at[1:], strict=False)):
        e = own.example[x + np.flatnonzero(codes[x:y] == ASK)]
        if len(e):
            bits = np.unpackbits(widen(replies[PARTNERS, b], np.uint8), count=len(e) * (length - gram + 1))
            i, back = np.nonzero(bits.reshape(len(e), -1))
            starts.append(own.place[e][i] - back)
            ends.append(starts[-1] + length)
    if (codes >= ASK_HOT).any():
        starts.append(_Single(data, own, codes, length).heard(replies, buckets))
        ends.append(starts[-1] + length)
    np.add.at(change, np.concatenate(starts), 1)
    np.add.at(change, np.concatenate(ends), -1)
    return np.cumsum(change, dtype=np.int32)[:-1] > 0


def remove_repeats(
    df: DataFrame, id: str = "doc_id", text: str = "text", length: int = 200, gram: int | None = None, hot: int = HOT
) -> DataFrame:
    """Per row its id, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (bytes).

    A byte goes when a string of ``length`` bytes that covers it starts anywhere else too.
    """
    gram = gram or max(1, length * 8 // 25)
    chunks: Chunks = chunked(df, id, text)
    buckets = chunks.buckets
    drop_bits = max(8, 64 - 12 - max(1, chunks.text_bytes).bit_length())

    def segments(texts) -> tuple[np.ndarray, np.ndarray, Segments]:
        data, starts = joined(texts)
        return data, starts, Segments(data, starts, length, gram, drop_bits)

    def first(chunk, ids, texts, rest, replies) -> Iterator[pa.RecordBatch]:
        yield from _ask_segments(chunk, segments(texts)[2], buckets)

    def second(chunk, ids, texts, rest, replies) -> Iterator[pa.RecordBatch]:
        data, _, own = segments(texts)
        codes = _codes(replies, own, buckets)
        yield from _show_partners(chunk, data, own, codes, length, buckets)
        if (codes >= ASK_HOT).any():
            yield from _Single(data, own, codes, length).ask(chunk, buckets)

    def third(chunk, ids, texts, rest, replies) -> Iterator[pa.RecordBatch]:
        data, starts, own = segments(texts)
        gone = _repeated(data, own, replies, length, gram, buckets)
        rises = gone.copy()
        rises[1:] &= ~gone[:-1]
        inner = starts[:-1][starts[:-1] < len(data)]
        rises[inner] = gone[inner]
        per_doc = [np.diff(np.append(0, np.cumsum(x))[starts]) for x in (gone, rises)]
        sizes = np.diff(starts)
        offsets = np.append(0, np.cumsum(sizes - per_doc[0])).astype(np.int32)
        kept = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[~gone])])
        counts = [pa.array(x.astype(np.int64)) for x in (sizes, *per_doc)]
        yield pa.RecordBatch.from_arrays([ids, *counts, kept], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    known = _replies(visit(chunks, None, first, ASKED), length, gram, hot)
    known = known.unionByName(_replies(visit(chunks, known, second, ASKED), length, gram, hot))
    schema = f"id {chunks.kinds['id']}, n_bytes long, n_removed long, n_spans long, kept binary"
    return visit(chunks, known, third, schema).withColumnRenamed("id", id)
