"""Repeated word windows against a brute-force search."""

import hashlib
import random
import re

import pytest

import __spark_entry__ as contract
from lakestrata.llm import chunks, substring


def brute(rows, words=20):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        found = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        gone = [False] * len(found)
        for i in range(len(found) - words + 1):
            window = tuple(found[i : i + words])
            if window in seen:
                gone[i : i + words] = [True] * words
            seen.add(window)
        kept = b" ".join(w for w, g in zip(found, gone, strict=True) if not g)
        out.append((doc, len(found), sum(gone), kept.decode()))
    return sorted(out, key=str)


def own(spark, rows, words=20):
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, kept int")
    return sorted(map(tuple, substring.remove_repeats(df, words=words).collect()), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_random(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 2000)
    parts = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(5, 60))) for _ in range(12)]
    rows = []
    for i in range(80):
        text = "\n".join(rnd.choice(parts) if rnd.random() < 0.6 else " ".join(rnd.choice("abcdé") for _ in range(30)) for _ in range(rnd.randint(0, 5)))
        rows.append((i if i % 7 else 3, text))
    rows += [(None, rows[5][1]), (200, None), (201, ""), (202, " \t\n"), (203, "x " * 5000), (204, "y" * 5000), (205, "a b " * 50)]
    assert own(spark, rows) == brute(rows)


def test_other_lengths_and_empty(spark):
    rows = [(1, "a b c d e f g"), (2, "x a b c d e f"), (2, "x a b c d e f")]
    for words in (1, 2, 3, 7):
        assert own(spark, rows, words) == brute(rows, words)
    assert own(spark, []) == []
    assert substring.lengths(20) == [5, 10, 20]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = [(d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in brute(rows)]
    got = sorted(map(tuple, contract.queries()["op1_substring_dedup"](spark, sf).collect()), key=str)
    assert got == sorted(want, key=str)
    assert sum(g for _, _, g, _ in want) > 1000
