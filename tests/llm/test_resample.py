"""Importance resampling against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lakestrata.llm import resample

BENCHMARK = ["the quick brown fox", "Jumps OVER é the lazy dog", None, ""]


def word_grams(text, longest):
    data = re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode())
    words = re.findall(rb"[0-9a-z\x80-\xff]+", data)
    return words, [b" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute(rows, target, longest=1, buckets=10_000, least=20, per_cent=10, seed=2024):
    def count(texts):
        return Counter(zlib.crc32(g) % buckets for t in texts for g in word_grams(t, longest)[1])

    s, t = count([r[1] for r in rows]), count(target)
    S, T = sum(s.values()), sum(t.values())
    out = []
    for id, text in rows:
        words, grams = word_grams(text, longest)
        weight = 0
        for g in grams:
            b = zlib.crc32(g) % buckets
            weight += math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
        h = int(hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([id, len(words), len(grams), weight, score, None])
    whole = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, r in enumerate(whole[: per_cent * len(whole) // 100]):
        r[5] = place + 1
    return sorted(map(tuple, out), key=str)


def texts(seed, n):
    rnd = random.Random(seed)
    own = ["the", "Fox", "dog-cat", "É", "x1", "lazy", "brown", "\x00", "zz", "\n", "ÀB", "1"]
    return [" ".join(rnd.choices(own, k=rnd.randint(0, 60))) for _ in range(n)]


ROWS = [(i, t) for i, t in enumerate(texts(1, 150))] + [(200, None), (201, ""), (None, texts(2, 1)[0] * 3), (202, " ,. "), (203, "the " * 400)]


def frames(spark, rows):
    kind = "doc_id long, text string, score string, row int, rank int"
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], kind)
    return docs.repartition(5), spark.createDataFrame([(t,) for t in BENCHMARK], "text string")


@pytest.mark.parametrize("longest,buckets,per_cent", [(1, 10_000, 10), (1, 7, 50), (2, 1000, 30), (4, 10_000, 100)])
def test_plain_loops(spark, longest, buckets, per_cent):
    docs, target = frames(spark, ROWS)
    options = {"longest": longest, "buckets": buckets, "per_cent": per_cent}
    got = resample.importance(docs, target, **options)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    want = brute(ROWS, BENCHMARK, **options)
    assert sorted(map(tuple, got.collect()), key=str) == want
    drawn = resample.draw(docs, target, **options)
    assert drawn.columns == docs.columns
    assert sorted((r.doc_id for r in drawn.collect()), key=str) == sorted((w[0] for w in want if w[5]), key=str)


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_long_texts_in_pieces(spark, longest, monkeypatch):
    monkeypatch.setattr(resample, "BATCH_BYTES", 64)
    rows = [(1, "x" * 500 + " the " * 9), (2, " ".join(texts(3, 40))), (3, "the dog"), (4, "a\x00b " * 100)]
    found = {}
    for i, t in rows:
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array([t])], ["text"])
        parts = list(resample._batches(batch, 0, longest, 1 << 40))
        found[i] = sorted(c for _, _, b, _ in parts for c in b.tolist())
        assert sum(w[0] for *_, w in parts) == len(word_grams(t, longest)[0])
        assert found[i] == sorted(map(zlib.crc32, word_grams(t, longest)[1]))


def test_no_gram_crosses_documents():
    row, checksum, words = resample.features([b"a b", b"", b"c", b"d e f"], 3)
    got = sorted(zip(row.tolist(), checksum.tolist(), strict=True))
    want = [(0, b"a"), (0, b"b"), (0, b"a b"), (2, b"c")]
    want += [(3, g) for g in (b"d", b"e", b"f", b"d e", b"e f", b"d e f")]
    assert got == sorted((i, zlib.crc32(g)) for i, g in want)
    assert words.tolist() == [2, 0, 1, 3]


def test_repeated_rows_each_have_a_rank(spark):
    """A third of all rows are one row, another third has no id: ranks are 1, 2, 3, ... all the same."""
    some = texts(4, 300)
    text = "the quick brown fox " * 10
    rows = [(7, text)] * 300 + [(None, t + " w" * 20) for t in some] + [(1000 + i, t + " w" * 20) for i, t in enumerate(some)]
    docs, target = frames(spark, rows)
    got = resample.importance(docs, target, per_cent=100).collect()
    assert sorted(r.rank for r in got) == list(range(1, 901))
    want = brute(rows, BENCHMARK, per_cent=100)
    assert sorted((str(r.doc_id), r.score) for r in got) == sorted((str(w[0]), w[4]) for w in want)
    for per_cent in (33, 50):
        assert resample.draw(docs, target, per_cent=per_cent).count() == per_cent * 900 // 100


def test_empty_tables(spark):
    docs, target = frames(spark, ROWS)
    none = docs.filter("false")
    assert resample.importance(none, target).collect() == []
    assert resample.draw(none, target).collect() == []
    rows = resample.importance(docs, target.filter("false")).collect()
    assert len(rows) == len(ROWS) and {r.weight for r in rows if r.n_words == 0} == {0}
    few, _ = frames(spark, ROWS[:5])
    assert {r.rank for r in resample.importance(few, target).collect()} == {None}


def test_a_worker_forgets_words(monkeypatch):
    monkeypatch.setattr(resample, "KEPT_WORDS", 3)
    data = b" ".join(b"%d" % i for i in range(50))
    _, checksum, _ = resample.features([data], 1)
    assert checksum.tolist() == [zlib.crc32(b"%d" % i) for i in range(50)]


def test_gains_floor_downwards():
    got = resample.gains(np.array([3, 0]), np.array([0, 1]))
    assert got.tolist() == [math.floor(1000 * math.log(1 * 5 / (4 * 3))), math.floor(1000 * math.log(2 * 5 / (1 * 3)))]
