"""Repeated byte strings against a brute-force search, and the two sorts against Python's."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as contract
from lakestrata.llm import chunks, suffixes


def brute(rows, length=200):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for doc, t in texts:
        change = [0] * (len(t) + 1)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                change[i] += 1
                change[i + length] -= 1
        covered, total = [], 0
        for x in change[:-1]:
            total += x
            covered.append(total > 0)
        spans = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        kept = bytes(b for b, c in zip(t, covered, strict=True) if not c)
        out.append((doc, len(t), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def own(spark, rows, **options):
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, kept int")
    found = suffixes.remove_repeats(df, **options).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found), key=str)


def random_rows(seed, size, n=60):
    rnd = random.Random(seed)
    parts = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(size // 2, size * 3))) for _ in range(8)]
    rows = []
    for i in range(n):
        text = "".join(
            (lambda p: p[rnd.randint(0, 5) : len(p) - rnd.randint(0, 5)])(rnd.choice(parts))
            if rnd.random() < 0.6
            else "".join(rnd.choice("xyzü") for _ in range(rnd.randint(0, size)))
            for _ in range(rnd.randint(0, 5))
        )
        rows.append((i % 50, text))
    return rows


@pytest.mark.parametrize(("length", "hot"), [(200, 4096), (20, 4096), (20, 2), (7, 1)])
def test_random(spark, length, hot, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(suffixes, "BLOCK", 1500)
    rows = random_rows(length, length)
    rows += [(None, rows[5][1]), (200, None), (201, ""), (203, "x" * 3000), (205, "ab" * 700), (206, "q" * length)]
    assert own(spark, rows, length=length, hot=hot) == brute(rows, length)


def test_empty(spark):
    assert own(spark, []) == []
    assert own(spark, [(1, None), (2, "short")]) == brute([(1, None), (2, "short")])


def test_deep_shallow():
    rnd = random.Random(1)
    for shallow in (0, 8, 16):
        strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 40))) for _ in range(300)]
        strings += [s + b"b" for s in strings[:50]] + strings[:30]
        sizes = np.array([len(s) for s in strings])
        table = np.zeros((len(strings), 48), np.uint8)
        for i, s in enumerate(strings):
            table[i, : len(s)] = list(s)
        groups = np.array([len(s) % 3 for s in strings])
        order = suffixes.deep_shallow(table, sizes, groups, shallow)
        want = sorted(range(len(strings)), key=lambda i: (groups[i], strings[i]))
        assert [(groups[i], strings[i]) for i in order] == [(groups[i], strings[i]) for i in want]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, contract.queries()["op7_suffix_array_dedup"](spark, sf).collect()), key=str)
    assert got == brute(rows)
