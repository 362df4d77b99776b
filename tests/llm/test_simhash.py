"""SimHash groups against brute force, and vantage-point trees against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

import __spark_entry__ as contract
from lakestrata.llm import simhash, vantage


def brute_fingerprint(text, size=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(points, radius=2):
    points = np.array(sorted(set(points)), np.uint64)
    root = list(range(len(points)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points[i + 1 :] ^ points[i]) <= radius).tolist():
            root[find(i)] = find(i + 1 + j)
    return {p: find(i) for i, p in enumerate(points.tolist())}


def brute(rows, radius=2):
    found = [(id, brute_fingerprint(text)) for id, text in rows]
    group = brute_groups([f for _, f in found], radius)
    least = {}
    for id, f in found:
        if id is not None:
            least[group[f]] = min(id, least.get(group[f], id))
    return sorted(((id, f"{f:016x}", least.get(group[f])) for id, f in found), key=str)


def clustered(rnd, n, spread):
    """Fingerprints of which half lie few bits around few centres."""
    centres = [rnd.getrandbits(64) for _ in range(5)]
    out = set()
    while len(out) < n:
        p = rnd.choice(centres) if rnd.random() < 0.5 else rnd.getrandbits(64)
        for _ in range(rnd.randint(0, spread)):
            p ^= 1 << rnd.randrange(64)
        out.add(p)
    return np.array(sorted(out), np.uint64)


def all_pairs(a, b, radius):
    return {(i, j) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(b ^ a[i]) <= radius).tolist()}


@pytest.mark.parametrize("seed,leaf,radius,spread", [(1, 4, 2, 3), (2, 16, 2, 8), (3, 8, 1, 2), (4, 8, 5, 12), (5, 2, 0, 3)])
def test_trees_find_all_pairs(seed, leaf, radius, spread, monkeypatch):
    monkeypatch.setattr(vantage, "LEAF", leaf)
    rnd = random.Random(seed)
    a, b = clustered(rnd, 600, spread), clustered(rnd, 400, spread)
    b = np.append(b, a[::7])
    want = {(i, j) for i, j in all_pairs(a, a, radius) if i < j}
    x, y = vantage.pairs(a, radius)
    got = list(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True))
    assert set(got) == want and len(got) == len(want)
    x, y = vantage.pairs(a, radius, b)
    got = list(zip(x.tolist(), y.tolist(), strict=True))
    assert set(got) == all_pairs(a, b, radius) and len(got) == len(set(got))


def test_points_that_no_vantage_point_splits():
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)  # all two bits apart
    many = np.repeat(one, 20)
    x, _ = vantage.pairs(many, 2)
    assert len(x) == len(many) * (len(many) - 1) // 2
    assert len(vantage.pairs(np.zeros(0, np.uint64), 2)[0]) == 0


@pytest.mark.parametrize("size", [1, 30, 3000])
def test_cells_hold_every_pair_once(size):
    rnd = random.Random(size)
    points = clustered(rnd, 1500, 4)
    sample = np.array(rnd.sample(points.tolist(), min(size, 300)), np.uint64)
    tree = vantage.router(sample, 1500 / len(sample), 100, 2)
    at, cell, side = tree.deal(points)
    got = []
    for c in set(cell.tolist()):
        here = cell == c
        a, b = at[here & (side == 0)], at[here & (side == 1)]
        if c in tree.two_sided:
            x, y = vantage.pairs(points[a], 2, points[b])
            got += zip(a[x].tolist(), b[y].tolist(), strict=True)
        else:
            assert not len(b)
            x, y = vantage.pairs(points[a], 2)
            got += zip(a[x].tolist(), a[y].tolist(), strict=True)
    got = [(min(p), max(p)) for p in got]
    assert set(got) == {(i, j) for i, j in all_pairs(points, points, 2) if i < j}
    assert len(got) == len(set(got))
    if size > 1:
        assert tree.inner and max(np.bincount(cell)) < 800


def test_forest_joins_the_same_groups():
    rnd = random.Random(9)
    x = np.array([rnd.randrange(500) for _ in range(400)])
    y = np.array([rnd.randrange(500) for _ in range(400)])
    a, b = vantage.forest(500, x, y)
    assert len(a) == len(set(a.tolist())) and (b < a).all()

    def groups(x, y):
        root = list(range(500))
        for _ in range(500):
            new = list(root)
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                new[i] = new[j] = min(new[i], new[j], root[i], root[j])
            if new == root:
                break
            root = new
        return root

    assert groups(a, b) == groups(x, y)


def test_fingerprints(monkeypatch):
    rnd = random.Random(5)
    texts = ["", " \t\n", "a", "A b", "É e", "one two three", "x " * 3000, "a b a b a b a b", "\x00 \x0b\x0cz\x1c y\x85"]
    texts += [" ".join(rnd.choices(["Q", "w", "é", "rr", "T-T"], k=rnd.randint(1, 90))) for _ in range(60)] + ["w" * 700 + " a b"]
    for piece in (1 << 20, 7, 64):
        monkeypatch.setattr(simhash, "PIECE_BYTES", piece)
        for t in texts:
            assert simhash.fingerprint(t.encode()) == brute_fingerprint(t)
            assert simhash.fingerprint(t.encode(), size=1) == brute_fingerprint(t, 1)


def near_rows(seed, n):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    bases = [rnd.choices(words, k=400) for _ in range(6)]
    rows = []
    for i in range(n):
        base = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 9])):
            base[rnd.randrange(len(base))] = rnd.choice(words)
        rows.append((1000 - i, " ".join(base)))
    return rows


@pytest.mark.parametrize("cell,block", [(16_384, 1 << 18), (8, 1 << 18), (40, 16)])
def test_groups(spark, cell, block, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = near_rows(3, 120) + [(2000, None), (2001, ""), (2002, " \n"), (None, "alone here with no id at all"), (2003, "a b"), (2004, "A  B")]
    rows += [rows[0], rows[1], (None, rows[2][1]), (-5, rows[3][1]), (2005, "z " * 50_000)]
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, fp int, n int, found string")
    got = simhash.classes(df)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    want = brute(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert len({c for _, _, c in want}) < len({f for _, f, _ in want})


def test_shared_ids_and_empty_tables(spark):
    """A third of the rows without an id, a third with one id and text, an empty table, one row."""
    rows = [(None, f"text number {i % 50} of some") for i in range(2000)] + [(7, "same old text")] * 2000 + near_rows(4, 20)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = simhash.classes(df).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.classes(none).collect() == []
    one = spark.createDataFrame([("k", None)], "doc_id string, text string")
    assert [tuple(r) for r in simhash.classes(one).collect()] == [("k", "0" * 16, "k")]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, contract.queries()["op13_simhash"](spark, sf).collect()), key=str)
    want = brute(rows)
    assert got == want
    assert len({c for _, _, c in want}) < len(rows)
