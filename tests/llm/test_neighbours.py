"""Nearest vectors against brute force."""

import numpy as np
import pytest

import __spark_entry__ as contract
from lakestrata.llm import neighbours


def brute(rows, asked, k):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = []
    for q in sorted({i for i, _ in asked} & good.keys()):
        scores = sorted(((-float(neighbours.exact_scores(good[q][None], v[None])[0]), i) for i, v in good.items() if i != q))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return out


def own(spark, rows, asked, **options):
    df, queries = (spark.createDataFrame([(*r, "x") for r in t], "vec_id long, embedding array<float>, rank string") for t in (rows, asked))
    return sorted(tuple(r) for r in neighbours.nearest(df, queries, **options).collect())


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 7)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 3)
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.integers(-3, 4, 4).astype(float).tolist()) for i in range(60)]
    rows = [r for r in rows if any(r[1])]
    rows += [(100 + i, [1.0, 2.0, 0.0, -1.0]) for i in range(30)]
    rows += [(200, None), (201, [0.0] * 4), (202, [1.0, None, 2.0, 3.0]), (203, [float("nan"), 1.0, 1.0, 1.0]), (204, [float("inf"), 1.0, 1.0, 1.0])]
    rows += [(None, [1.0, 1.0, 1.0, 1.0])]
    asked = [r for r in rows if r[0] is not None and r[0] % 5 == 0]
    assert own(spark, rows, asked, k=6) == sorted(brute(rows, asked, 6))
    assert own(spark, rows[:4], rows[:2], k=6) == sorted(brute(rows[:4], rows[:2], 6))
    assert own(spark, [*rows, rows[0], rows[65]], [*asked, asked[0]], k=6) == sorted(brute(rows, asked, 6))
    assert own(spark, [], [], k=6) == []


def test_hot_id_counts_once(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.integers(-3, 4, 4).astype(float).tolist()) for i in range(40)]
    rows = [r for r in rows if any(r[1])]
    hot = [(500, [9.0, 9.0, 9.0, float(i % 30)]) for i in range(60)] + [(501, [-9.0, -9.0, 9.0, 9.0])] * 30
    asked = rows[::4]
    scores = lambda q, v: float(neighbours.exact_scores(np.array([q]), np.array([v]))[0])
    want = []
    for q, x in asked:
        best = {}
        for i, v in [*rows, *hot]:
            if i != q:
                best[i] = max(best.get(i, -np.inf), scores(x, v))
        want += [(q, n, i, s) for n, (i, s) in enumerate(sorted(best.items(), key=lambda t: (-t[1], t[0]))[:20], 1)]
    assert own(spark, [*rows, *hot], [*asked, *asked[:2]], k=20) == sorted(want)


def test_parts():
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(8, 16)) * 3
    x = centres[rnd.integers(0, 8, 2000)] + rnd.normal(size=(2000, 16)) * 0.3
    graph = neighbours.neighbour_graph(x, 10)
    label = neighbours.balanced_parts(graph, 8)
    assert np.bincount(label, minlength=8).max() <= np.ceil(250 * 1.05)
    assert (label[graph] == label[:, None]).mean() > 0.8
    router = neighbours.fit(x, 8, 10)
    assert router.probes <= 4


def test_visited():
    order = np.array([[2, 0, 1, 3], [0, 1, 2, 3], [3, 2, 1, 0]])
    ids = np.array([5, 0, 30, 2])
    assert neighbours.visited(order, ids, 1, 20).tolist() == [1, 3, 2]
    assert neighbours.visited(order, ids, 2, 20).tolist() == [2, 3, 2]
    assert neighbours.visited(order, ids, 1, 50).tolist() == [4, 4, 4]


def vectors(kind, rnd, n=6200, width=16):
    if kind == "spread":
        return rnd.normal(size=(n, width))
    if kind == "clustered":
        return rnd.normal(size=(40, width))[rnd.integers(0, 40, n)] * 3 + rnd.normal(size=(n, width)) * 0.3
    x = rnd.normal(size=(n, width))
    x[: n // 3] = x[0]  # copies of one vector
    return x


@pytest.mark.parametrize("parts", [16, 64])
@pytest.mark.parametrize("kind", ["spread", "clustered", "copies"])
def test_routed_recall(spark, kind, parts):
    """What parts hold is found by their ranks: a neighbour counts if its score reaches that of the true k-th."""
    x = vectors(kind, np.random.default_rng(4))
    assert neighbours.fit(x, parts, 20).parts == parts
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df.filter("vec_id % 20 = 0"), parts=parts).toPandas()
    assert (got.groupby("query_id")["rank"].count() == 20).all() and got.query_id.nunique() == 310
    hits = 0
    for q, rows in got.groupby("query_id"):
        scores = neighbours.exact_scores(np.broadcast_to(x[q], x.shape), x)
        least = np.sort(np.delete(scores, q))[-20]
        assert q not in set(rows.vec_id)
        hits += (rows.score >= least).sum()
    print(kind, parts, f"recall {hits / (20 * 310):.3f}")
    assert hits >= 0.9 * 20 * 310


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = contract.queries()["op8_learned_partitions"](spark, sf).collect()
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    found = {(r.query_id, r.vec_id): r.score for r in got}
    assert len(got) == len(want)
    hits = [(q, i, s) for q, _, i, s in want if (q, i) in found]
    assert len(hits) >= 0.9 * len(want)
    assert all(found[q, i] == pytest.approx(s, abs=1e-15) for q, i, s in hits)
    by_query = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by_query.setdefault(r.query_id, []).append(r)
    for rows_ in by_query.values():
        assert [r.rank for r in rows_] == list(range(1, len(rows_) + 1))
        assert [(-r.score, r.vec_id) for r in rows_] == sorted((-r.score, r.vec_id) for r in rows_)
