"""Benchmark passages against a plain search of every window."""

import random
import re

import pytest

from lakestrata.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    patterns = {}
    for item, text in items:
        found = words(text)
        size = min(window, len(found))
        for i in range(len(found) - size + 1 if size else 0):
            patterns.setdefault(tuple(found[i : i + size]), set()).add("null" if item is None else str(item))
    out = []
    for doc, text in docs:
        found = words(text)
        hit, names = [False] * len(found), set()
        for size in {len(p) for p in patterns}:
            for i in range(len(found) - size + 1):
                owners = patterns.get(tuple(found[i : i + size]))
                if owners:
                    hit[i : i + size] = [True] * size
                    names |= owners
        n = sum(hit)
        out.append((doc, len(found), n, sorted(names), len(names), n > 0 and 20 * n >= len(found)))
    return sorted(out, key=str)


def data(seed):
    rnd = random.Random(seed)

    def prose(n):
        return " ".join(rnd.choice(["the", "of", "a", "Ünd", "x1", "b-c", "I"]) for _ in range(n))

    items = [(i, prose(rnd.choice([0, 1, 2, 5, 13, 14, 30, 40]))) for i in range(25)]
    items += [(None, prose(20)), (3, None), (4, items[7][1]), (5, "!!!"), (6, "")]
    docs = []
    for i in range(60):
        text = prose(rnd.choice([0, 3, 50, 300])) + "\n" + (rnd.choice(items)[1] or "") + "\t" + prose(5)
        docs.append((i % 50, text.upper() if i % 9 == 0 else text))
    return [*docs, (None, items[9][1]), (70, None), (71, ""), (72, prose(30_000))], items


@pytest.mark.parametrize(("seed", "window", "block"), [(1, 13, 500_000), (2, 4, 500_000), (3, 13, 100)])
def test_random(spark, seed, window, block, monkeypatch):
    monkeypatch.setattr(decontam, "PATTERNS_PER_BLOCK", block)
    docs, items = data(seed)
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontam.find(d, b, window=window).collect()), key=str)
    assert got == brute(docs, items, window)


def test_pieces():
    text = " ".join(f"w{i}é" for i in range(100)) + " ."
    for window, most in ((13, 10), (13, 88), (5, 1), (1, 7), (200, 10)):
        cut = [words(p) for p in decontam.pieces(text, window, most)]
        runs = lambda found: [tuple(found[i : i + window]) for i in range(max(1, len(found) - window + 1))]
        assert [r for p in cut for r in runs(p)] == runs(words(text))
        assert all(len(runs(p)) <= most for p in cut)
    assert list(decontam.pieces(" .", 13, 5)) == list(decontam.pieces("", 13, 5)) == []


def test_repeated_and_long_items(spark, monkeypatch):
    """Copies of an item make no block larger, and no block holds more than a part of a long item."""
    monkeypatch.setattr(decontam, "PATTERNS_PER_BLOCK", 640)
    sizes = []
    search = decontam._blocks
    monkeypatch.setattr(decontam, "_blocks", lambda *a: (sizes.append(sum(len(words(t)) for _, t in b.value[1])) or b for b in search(*a)))
    docs, items = data(5)
    rnd = random.Random(6)
    long = " ".join(rnd.choice("abcdefgh") for _ in range(3000))
    items = items + [(80, long)] + [items[8]] * 2000
    docs = [*docs, (90, "x " + " ".join(words(long)[500:700]) + " y")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontam.find(d, b, window=13).collect()), key=str)
    assert got == brute(docs, items, 13)
    assert len(sizes) > 5 and max(sizes) <= 640 * 2


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [r.contaminated for r in decontam.find(d, b).collect()] == [True]
    assert decontam.find(d.limit(0), b).collect() == []
    assert [tuple(r) for r in decontam.find(d, b.limit(0)).collect()] == [(1, 2, 0, [], 0, False)]
