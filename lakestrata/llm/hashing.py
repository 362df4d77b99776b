"""Rolling hashes of bytes and words, computed for whole arrays at once."""

from __future__ import annotations

import numpy as np

BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes between words for comparisons: everything ASCII but letters and digits.
MARKS = np.ones(256, bool)
MARKS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Lower case for A-Z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
#: Bytes hashed at a time.
BLOCK = 1 << 17


class _Powers:
    """Powers of an odd number and of its inverse modulo 2 to the 64, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK + 4096)
            self.up, self.down = (
                np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]))
                for base in (_BASE, _INVERSE)
            )
        return self.up[:n], self.down[:n]


_powers = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """One number more than values: what :func:`span_hashes` needs of them."""
    up, _ = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts, ends) -> np.ndarray:
    """Hash of the values from each start to before each end; equal for equal values wherever they stand."""
    _, down = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def byte_sums(data: np.ndarray) -> np.ndarray:
    return prefix_sums(_TABLE[data])


def words(data: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a byte array; ``between`` marks the bytes that separate them."""
    starts, ends, hashes = [], [], []
    at = 0
    while at < len(data):
        stop = min(at + BLOCK, len(data))
        while stop < len(data) and not between[data[stop]]:  # a block ends between words
            rest = np.flatnonzero(between[data[stop : stop + BLOCK]])
            stop = stop + int(rest[0]) if len(rest) else min(stop + BLOCK, len(data))
        block = data[at:stop]
        inside = np.zeros(len(block) + 2, np.int8)
        inside[1:-1] = ~between[block]
        edges = np.flatnonzero(np.diff(inside))
        a, b = edges[::2], edges[1::2]
        starts.append(a + at)
        ends.append(b + at)
        hashes.append(span_hashes(byte_sums(block), a, b))
        at = stop
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words, by the position of its first."""
    count = max(0, len(hashes) - n + 1)
    at = np.arange(count)
    return span_hashes(prefix_sums(hashes), at, at + n)
