"""Pairs of 64-bit fingerprints that differ in few bits, by vantage-point trees.

A vantage point splits fingerprints by their Hamming distance from it into a ball and the rest. By the triangle
inequality two fingerprints that differ in at most ``radius`` bits have distances that differ by no more, so a pair
across the split lies in the two rings along the boundary: a cell's pairs are those within the ball, those within the rest,
and those between the rings. The same split prunes a cell of two sides (``a`` against ``b``). Every pair is compared in
exactly one cell.

The first levels of the tree are made from a sample and deal fingerprints to cells, which tasks then work through one
by one; below that, a task splits its cell further. The sample decides how even cells are, not which pairs are found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Fingerprints on a side below which all pairs are compared at once.
LEAF = 256
#: Vantage points tried for a split, and the largest share of a side that may stay together.
TRIES = 4
LARGEST = 0.9


def distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def threshold(distance: np.ndarray, radius: int) -> int:
    """Where to split: near the median, with as few as possible along the boundary."""
    count = np.bincount(distance, minlength=65 + 2 * radius)
    below = np.cumsum(count)
    middle = int(np.searchsorted(below, below[-1] / 2))
    near = range(max(0, middle - 3), min(64, middle + 3) + 1)

    def cost(mu: int) -> tuple[float, int]:
        ball = below[mu] / below[-1]
        ring = count[max(0, mu - radius + 1) : mu + radius + 1].sum() / below[-1]
        return max(ball, 1 - ball) + ring, mu

    return min(map(cost, near))[1]


@dataclass
class Split:
    vantage: np.uint64
    mu: int

    def cut(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which points lie in the ball, in the rest, and in the rings within and without."""
        d = distances(points, self.vantage)
        ball = d <= self.mu
        return ball, ~ball, ball & (d > self.mu - radius), ~ball & (d <= self.mu + radius)


def _split(points: np.ndarray, radius: int) -> Split | None:
    """A split of some points, or None where none of a few vantage points takes them apart."""
    for i in range(TRIES):
        vantage = points[len(points) * (2 * i + 1) // (2 * TRIES)]
        d = distances(points, vantage)
        mu = threshold(d, radius)
        share = np.count_nonzero(d <= mu) / len(points)
        if 1 - LARGEST <= share <= LARGEST:
            return Split(vantage, mu)
    return None


def _close(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of close points, by blocks of bounded size."""
    found = []
    for i in range(0, len(a), LEAF):
        for j in range(0, len(b), 4 * LEAF):
            near = np.bitwise_count(a[i : i + LEAF, None] ^ b[None, j : j + 4 * LEAF]) <= radius
            x, y = np.nonzero(near)
            found.append((x + i, y + j))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = zip(*found, strict=True)
    return np.concatenate(x), np.concatenate(y)


def pairs(a: np.ndarray, radius: int, b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs at most ``radius`` apart: within ``a``, each once, or of ``a`` against ``b``."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [(np.arange(len(a)), None if b is None else np.arange(len(b)))]
    while todo:
        i, j = todo.pop()
        if not len(i) or (j is not None and not len(j)):
            continue
        own, other = a[i], None if j is None else b[j]
        large = max(len(i), 0 if j is None else len(j))
        split = _split(own if j is None or len(i) >= len(j) else other, radius) if large > LEAF else None
        if split is None:
            x, y = _close(own, own if other is None else other, radius)
            if other is None:
                once = x < y
                x, y = x[once], y[once]
            found.append((i[x], (i if j is None else j)[y]))
            continue
        ball, rest, within, without = split.cut(own, radius)
        if j is None:
            todo += [(i[ball], None), (i[rest], None)]
            # a cell of two sides from here on: both sides are positions in a
            x, y = pairs(own[within], radius, own[without])
            found.append((i[within][x], i[without][y]))
            continue
        ball_b, rest_b, within_b, without_b = split.cut(other, radius)
        todo += [(i[ball], j[ball_b]), (i[rest], j[rest_b]), (i[within], j[without_b]), (i[without], j[within_b])]
    x, y = zip(*found, strict=True) if found else ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
    return np.concatenate(x), np.concatenate(y)


@dataclass
class Router:
    """The upper levels of a tree: splits by cell, and the cells below each."""

    radius: int
    #: Per inner cell its split and the cells below: ball, rest, rings; for cells of two sides both pairs of rings.
    inner: dict[int, tuple[Split, tuple[int, ...]]]
    two_sided: set[int]
    cells: int

    def deal(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, cell, side) of every place a point has among the undivided cells; cells of one side have side 0."""
        out = []
        todo = [(0, np.arange(len(points)), np.zeros(len(points), np.int8))]
        while todo:
            cell, at, side = todo.pop()
            if not len(at):
                continue
            if cell not in self.inner:
                out.append((at, np.full(len(at), cell), side))
                continue
            split, below = self.inner[cell]
            ball, rest, within, without = split.cut(points[at], self.radius)
            todo += [(below[0], at[ball], side[ball]), (below[1], at[rest], side[rest])]
            if cell in self.two_sided:
                one = side == 0
                for child, first, second in ((below[2], within & one, without & ~one), (below[3], without & one, within & ~one)):
                    both = first | second
                    todo.append((child, at[both], side[both]))
            else:
                both = within | without
                todo.append((below[2], at[both], without[both].astype(np.int8)))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def router(sample: np.ndarray, each: float, most: float, radius: int) -> Router:
    """Splits cells as long as more than ``most`` points are expected in one; a sample point stands for ``each``."""
    inner: dict[int, tuple[Split, tuple[int, ...]]] = {}
    two_sided: set[int] = set()
    cells = 1
    todo: list[tuple[int, np.ndarray, np.ndarray | None]] = [(0, sample, None)]
    while todo:
        cell, a, b = todo.pop()
        if (len(a) + (0 if b is None else len(b))) * each <= most:
            continue
        split = _split(a if b is None or len(a) >= len(b) else b, radius)
        if split is None:
            continue
        ball, rest, within, without = split.cut(a, radius)
        if b is None:
            below = [(a[ball], None), (a[rest], None), (a[within], a[without])]
        else:
            ball_b, rest_b, within_b, without_b = split.cut(b, radius)
            below = [(a[ball], b[ball_b]), (a[rest], b[rest_b]), (a[within], b[without_b]), (a[without], b[within_b])]
        numbers = tuple(range(cells, cells + len(below)))
        cells += len(below)
        inner[cell] = (split, numbers)
        two_sided.update(n for n, (_, second) in zip(numbers, below, strict=True) if second is not None)
        todo += [(n, *sides) for n, sides in zip(numbers, below, strict=True)]
    return Router(radius, inner, two_sided, cells)


def forest(n: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (point, least point of its group) that join just what the pairs join."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            further = new[new]
            if np.array_equal(further, new):
                break
            new = further
        if np.array_equal(new, label):
            moved = np.flatnonzero(label != np.arange(n))
            return moved, label[moved]
        label = new
