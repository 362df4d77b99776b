"""Merges on ranges and on alternatives against a nested-loop MERGE, and how they are joined."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_merge import brute_merge, rows

from lakestrata.operators import interval
from lakestrata.operators.interval import Bounds, overlap_join
from lakestrata.operators.merge import AmbiguousMerge, UnboundedMerge, merge_all, read_condition
from lakestrata.operators.upsert import merge_into
from lakestrata.sources.tables import Table

ROW = "id long, low double, high double, val string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def split_bins(monkeypatch):
    """Split bins also on small tables."""
    for name, value in {"ROWS_PER_TASK": 15, "SPLITS": 10_000}.items():
        monkeypatch.setattr(interval, name, value)


def random_intervals(rng, n, span, wide):
    out = []
    for i in range(n):
        low = rng.choice([rng.uniform(-1e6, 1e6), float(rng.randrange(-50, 50)), 7.0])
        length = rng.choice([0.0, rng.uniform(0, span), rng.uniform(0, wide)])
        out.append((i, low, low + length, f"v{i}"))
    odd = [(n, None, 1.0, "a"), (n + 1, 1.0, None, "b"), (n + 2, None, None, "c"), (n + 3, -1e9, 1e9, "all")]
    odd += [(n + 4, 9.0, -9.0, "turned"), (n + 5, float("-inf"), float("inf"), "inf"), (n + 6, float("nan"), float("nan"), "nan")]
    return out + odd


def ordered(value):
    return (value != value, 0.0 if value != value else value)  # NaN is above all numbers, as in Spark


def pairs_of(left, right):
    return sorted(
        (a[0], b[0]) for a in left for b in right
        if None not in (a[1], a[2], b[1], b[2]) and ordered(a[1]) <= ordered(b[2]) and ordered(b[1]) <= ordered(a[2])
    )


@pytest.mark.parametrize("seed", range(4))
def test_overlap_join_finds_each_pair_once(spark, seed, split_bins):
    rng = random.Random(seed)
    left, right = random_intervals(rng, 120, 5, 1e5), random_intervals(rng, 60, 300, 1e6)
    t, s = spark.createDataFrame(left, ROW), spark.createDataFrame(right, ROW)
    bounds = Bounds(("t.low", "t.high"), ("s.low", "s.high"))
    joined = overlap_join(t, s, bounds, "t.low <= s.high AND s.low <= t.high")
    assert sorted((r.t.id, r.s.id) for r in joined.collect()) == pairs_of(left, right)
    back = overlap_join(s, t, bounds, "t.low <= s.high AND s.low <= t.high")
    assert sorted((r.s.id, r.t.id) for r in back.collect()) == pairs_of(left, right)


def test_overlap_join_of_small_and_empty_tables(spark):
    t = spark.createDataFrame([(1, 1.0, 2.0, "a")], ROW)
    bounds = Bounds(("t.low", "t.high"), ("s.low", "s.high"))
    for other in (t, t.filter("false")):
        for one, two in ((t, other), (other, t)):
            found = overlap_join(one, two, bounds, "t.low <= s.high AND s.low <= t.high").count()
            assert found == (1 if other is t else 0)


def disjoint(rng, n):
    ends = sorted(rng.sample(range(0, 2000), 2 * n))
    return [(1000 + i, float(a), float(b), f"s{i}") for i, (a, b) in enumerate(zip(ends[::2], ends[1::2], strict=True))]


@pytest.mark.parametrize("seed", range(3))
def test_values_in_intervals(spark, seed, split_bins):
    rng = random.Random(seed)
    values = [rng.randrange(0, 2000) for _ in range(150)] + [5] * 40
    target = [(i, float(v), float(v), "t") for i, v in enumerate(values)] + [(1, 5.0, 5.0, "same"), (1, 5.0, 5.0, "same"), (2, None, 3.0, "null")]
    source = disjoint(rng, 25) + [(5000, None, 4.0, "null")]
    t, s = spark.createDataFrame(target, ROW), spark.createDataFrame(source, ROW)

    def inside(t, s):
        return None not in (t[1], s[1]) and s[1] <= t[1] < s[2]

    want = brute_merge(target, source, inside)
    assert rows(merge_all(t, s, condition="t.low >= s.low AND t.low < s.high")) == want
    assert rows(merge_all(t, s, condition="s.high > t.low AND NOT (t.low < s.low) AND t.low >= s.low")) == want
    between = brute_merge(target, source, lambda t, s: None not in (t[1], s[1]) and s[1] <= t[1] <= s[2] - 1)
    assert rows(merge_all(t, s, condition="t.low BETWEEN s.low AND s.high - 1")) == between
    younger = brute_merge(target, source, inside, lambda t, s: (s[0] % 2, s[0]) >= (t[0] % 2, t[0]))
    parity = merge_all(
        t.withColumn("odd", F.col("id") % 2), s.withColumn("odd", F.col("id") % 2),
        condition="t.low >= s.low AND t.low < s.high", newest_by=["odd", "id"],
    )
    assert rows(parity.drop("odd")) == younger


def test_several_intervals_are_ambiguous(spark):
    t = spark.createDataFrame([(1, 5.0, 5.0, "t")], ROW)
    overlapping = spark.createDataFrame([(2, 1.0, 6.0, "a"), (3, 4.0, 9.0, "b")], ROW)
    twice = spark.createDataFrame([(2, 1.0, 6.0, "a"), (2, 1.0, 6.0, "a")], ROW)
    for s in (overlapping, twice):
        with pytest.raises(AmbiguousMerge):
            merge_all(t, s, condition="t.low BETWEEN s.low AND s.high")


def test_rows_that_differ_in_where_a_null_stands(spark):
    kind = "a string, b string, x double"
    t = spark.createDataFrame([("p", None, 1.0), (None, "p", 1.0), ("p", None, 50.0)], kind)
    s = spark.createDataFrame([("q", None, 1.5), (None, "q", 77.0)], kind)
    got = rows(merge_all(t, s, condition="t.x BETWEEN s.x - 1 AND s.x + 1 AND t.a = 'p'"))
    assert got == sorted([("q", None, 1.5), (None, "p", 1.0), ("p", None, 50.0), (None, "q", 77.0)], key=repr)


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
def test_dates_and_times(spark, kind):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    text = spark.createDataFrame([(i, d.isoformat(), d.isoformat(), "t") for i, d in enumerate(days)], "id long, low string, high string, val string")
    t = text.withColumns({c: F.col(c).cast(kind) for c in ("low", "high")})
    s = spark.createDataFrame([(100, "2024-01-10", "2024-01-20", "s"), (101, "2025-01-01", "2025-01-02", "new")], text.schema)
    s = s.withColumns({c: F.col(c).cast("date") for c in ("low", "high")}) if kind == "date" else s.withColumns({c: F.col(c).cast(kind) for c in ("low", "high")})
    got = merge_all(t, s, condition="t.low BETWEEN s.low AND s.high").groupBy("val").count().collect()
    assert {r.val: r["count"] for r in got} == {"t": 49, "s": 11, "new": 1}
    near = merge_all(t, s, condition="t.low > s.low - INTERVAL 2 DAYS AND t.low < s.low + INTERVAL 2 DAYS")
    assert near.filter("val = 's'").count() == 3


def test_axes_that_do_not_fit_are_refused(spark):
    t = spark.createDataFrame([(1, "a", "b")], "id long, low string, high string")
    with pytest.raises(UnboundedMerge):
        merge_all(t, t, condition="t.low BETWEEN s.low AND s.high")
    assert rows(merge_all(t, t, condition="t.low BETWEEN s.low AND s.high", all_pairs=True)) == [(1, "a", "b")]
    for condition in ("t.low > s.low", "t.id > 3", "t.id = 1 OR t.low = s.low", "abs(t.id - s.id) < 2"):
        with pytest.raises(UnboundedMerge):
            merge_all(t, t, condition=condition)


def test_one_interval_over_all_rows_is_split(spark, monkeypatch):
    """The interval becomes some rows, no task compares all of them, and no plan compares all pairs."""
    monkeypatch.setattr(interval, "ROWS_PER_TASK", 1000)
    t = spark.range(40_000).select("id", F.col("id").cast("double").alias("low"), F.col("id").cast("double").alias("high"), F.lit("t").alias("val"))
    s = spark.createDataFrame([(-1, -1.0, 1e9, "all")], ROW)
    dealt, tasks = [], interval._dealt

    def watched(*args):
        dealt.append(tasks(*args))
        return dealt[-1]

    monkeypatch.setattr(interval, "_dealt", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = merge_all(t, s, condition="t.low BETWEEN s.low AND s.high")
        assert merged.filter("val = 'all'").count() == 40_000
        text = plan_of(merged)
        assert "NestedLoop" not in text and "Cartesian" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    points, whole = dealt[0], dealt[1]
    assert 8 <= whole.count() <= 200
    assert points.groupBy("_key", "_i", "_j").count().agg(F.max("count")).first()[0] < 4000
    assert points.count() == 40_000


def test_hot_value_is_split(spark, monkeypatch):
    """A third of all rows on one day, inside one interval."""
    monkeypatch.setattr(interval, "ROWS_PER_TASK", 2000)
    t = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("low"))
    t = t.select("id", "low", F.col("low").alias("high"), F.lit("t").alias("val"))
    s = spark.createDataFrame([(-1, 4.5, 5.5, "hot"), (-2, 100.0, 120.0, "b"), (-3, -9.0, -8.0, "none")], ROW)
    got = {r.val: r["count"] for r in merge_all(t, s, condition="t.low BETWEEN s.low AND s.high").groupBy("val").count().collect()}
    hits = [5.0 if i % 3 == 0 else float(i) for i in range(30_000)]
    assert got["hot"] == sum(4.5 <= h <= 5.5 for h in hits)
    assert got["b"] == sum(100 <= h <= 120 for h in hits)
    assert got["none"] == 1 and got["t"] == 30_000 - got["hot"] - got["b"]


@pytest.mark.parametrize("seed", range(3))
def test_alternatives(spark, seed):
    rng = random.Random(seed)
    target = [(i, float(rng.randrange(60)), 0.0, rng.choice(["x", "y"])) for i in range(40)] + [(None, None, 1.0, "null"), (3, 1.0, 1.0, "x")]
    source = [(100 + i if rng.random() < 0.6 else rng.randrange(40), 200.0 + i, 0.0, "s") for i in range(12)]
    source = list({r[0]: r for r in source}.values()) + [(None, None, 2.0, "null")]
    used = {r[0] for r in source}
    free = [v for v in range(60) if sum(t[1] == v for t in target) and not any(t[1] == v and t[0] in used for t in target)][:4]
    source += [(300 + i, float(v), 0.0, "by low") for i, v in enumerate(free)]
    t, s = spark.createDataFrame(target, ROW), spark.createDataFrame(source, ROW)

    def either(t, s):
        return None not in (t[0], s[0]) and t[0] == s[0] or None not in (t[1], s[1]) and t[1] == s[1]

    merged = merge_all(t, s, condition="t.id = s.id OR t.low = s.low")
    assert rows(merged) == brute_merge(target, source, either)
    text = plan_of(merged)
    assert "NestedLoop" not in text and "Cartesian" not in text
    some = merge_all(t, s, condition="(t.id = s.id OR t.low = s.low) AND t.val = 'x'")
    assert rows(some) == brute_merge(target, source, lambda t, s: either(t, s) and t[3] == "x")
    ranged = merge_all(t, s, condition="t.id = s.id OR (t.low BETWEEN s.low - 0.5 AND s.low + 0.5)")
    assert rows(ranged) == brute_merge(target, source, either)


def test_a_pair_found_twice_is_one_match(spark):
    t = spark.createDataFrame([(1, 5.0, 0.0, "t")], ROW)
    s = spark.createDataFrame([(1, 5.0, 9.0, "s")], ROW)
    assert rows(merge_all(t, s, condition="t.id = s.id OR t.low = s.low")) == [(1, 5.0, 9.0, "s")]
    for other in ([(1, 6.0, 9.0, "s"), (2, 5.0, 9.0, "s")], [(1, 5.0, 9.0, "s"), (1, 5.0, 9.0, "s")], [(1, 6.0, 9.0, "s"), (1, 7.0, 9.0, "s")]):
        with pytest.raises(AmbiguousMerge):
            merge_all(t, spark.createDataFrame(other, ROW), condition="t.id = s.id OR t.low = s.low")


def test_a_key_that_both_sides_repeat_is_found_out_before_the_join(spark):
    """Half of each side under one key would be a hundred million pairs."""
    t = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("id").cast("double")).alias("low"))
    t = t.select("id", "low", F.lit(0.0).alias("high"), F.lit("t").alias("val"))
    s = t.withColumn("id", F.col("id") + 50_000)
    with pytest.raises(AmbiguousMerge):
        merge_all(t, s, condition="t.id = s.id OR t.low = s.low")


def test_cases_of_conditions():
    assert [a.text.count("=") for a in read_condition("t.a = s.a OR t.b = s.b").alternatives] == [1, 1]
    cases = read_condition("(t.a = s.a OR t.b = s.b) AND (t.c > 1 OR s.d < 2)").alternatives
    assert len(cases) == 4 and all(c.joins and c.equal is None for c in cases)
    wide = " AND ".join(f"(t.a{i} = s.a{i} OR t.b{i} = s.b{i})" for i in range(6))
    with pytest.raises(UnboundedMerge, match="alternatives"):
        read_condition(wide)
    point = read_condition("t.x >= s.a AND s.c >= t.y AND t.x <= s.b").alternatives[0].bounds
    assert point == Bounds(("t.x", "t.x"), ("s.a", "s.b"))


def test_stored_merges(spark, folder):
    table = Table(spark, folder)
    target = [(i, float(i), float(i), "t") for i in range(50)]
    table.overwrite(spark.createDataFrame(target, ROW))
    source = [(100, 10.0, 19.5, "s"), (101, 70.0, 80.0, "new")]
    merge_into(table, spark.createDataFrame(source, ROW), condition="t.low BETWEEN s.low AND s.high")
    want = brute_merge(target, source, lambda t, s: s[1] <= t[1] <= s[2])
    assert rows(table.read()) == want
    more = [(100, 500.0, 0.0, "again"), (7, 501.0, 0.0, "seven")]
    merge_into(table, spark.createDataFrame(more, ROW), condition="t.id = s.id OR t.low = s.low")
    assert rows(table.read()) == brute_merge(want, more, lambda t, s: t[0] == s[0] or t[1] == s[1])
