"""Merges against a plain nested-loop MERGE on small random tables."""

import random

import pytest

from lakestrata.operators.latest import latest_per_key, latest_per_key_agg
from lakestrata.operators.merge import (
    NEWEST_WINS,
    AmbiguousMerge,
    UnboundedMerge,
    align,
    equality_keys,
    merge_all,
    merge_unique,
    read_condition,
)
from lakestrata.operators.upsert import merge_into, upsert
from lakestrata.sources.tables import Table

ROW = "id long, grp string, ts long, val string"


def brute_merge(target, source, matches, take=lambda t, s: True):
    out, used = [], set()
    for t in target:
        hits = [i for i, s in enumerate(source) if matches(t, s)]
        assert len(hits) <= 1
        used.update(hits)
        out.append(source[hits[0]] if hits and take(t, source[hits[0]]) else t)
    return sorted(out + [s for i, s in enumerate(source) if i not in used], key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same_id(t, s):
    return t[0] is not None and t[0] == s[0]


TIES = ["val", "grp"]


def younger(t, s):
    return (s[2], s[3], s[1]) >= (t[2], t[3], t[1])


def random_rows(rng, n, ids, unique):
    chosen = rng.sample(ids, n) if unique else [rng.choice(ids) for _ in range(n)]
    made = [(i, rng.choice("ab"), rng.randrange(20), f"v{rng.randrange(100)}") for i in chosen]
    return made + [(None, "a", 1, "null-key")]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_merge_all_is_merge(spark, seed, threshold):
    rng = random.Random(seed)
    target = random_rows(rng, 40, range(25), unique=False)
    source = random_rows(rng, 15, range(40), unique=True)
    t, s = spark.createDataFrame(target, ROW), spark.createDataFrame(source, ROW)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        assert rows(merge_all(t, s, on="id")) == brute_merge(target, source, same_id)
        newest = merge_all(t, s, on="id", newest_by="ts", tie_breakers=TIES)
        assert rows(newest) == brute_merge(target, source, same_id, younger)
        condition = "t.id = s.id and t.grp = 'a'"
        want = brute_merge(target, source, lambda t, s: same_id(t, s) and t[1] == "a")
        assert rows(merge_all(t, s, condition=condition)) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("seed", range(3))
def test_merge_unique_is_merge(spark, seed):
    rng = random.Random(seed)
    target = random_rows(rng, 20, range(40), unique=True)
    source = random_rows(rng, 15, range(40), unique=True)
    t, s = spark.createDataFrame(target, ROW), spark.createDataFrame(source, ROW)
    assert rows(merge_unique(t, s, "id")) == brute_merge(target, source, same_id)
    newest = merge_unique(t, s, "id", newest_by="ts", tie_breakers=TIES)
    # A stale source row is dropped, its target row stays.
    assert rows(newest) == brute_merge(target, source, same_id, younger)


@pytest.mark.parametrize("small_source", [0, 1 << 20])
@pytest.mark.parametrize("unique", [True, False])
def test_stored_merges_are_merges(spark, folder, small_source, unique):
    rng = random.Random(7)
    table = Table(spark, folder)
    stored = random_rows(rng, 30, range(60), unique=unique)
    merge_into(table, spark.createDataFrame(stored, ROW), on="id", buckets=5)
    assert table.meta()["unique"] == unique
    for round_ in range(4):
        batch = random_rows(rng, 6, range(90), unique=True)
        newest = "ts" if round_ % 2 else None
        take = younger if newest else (lambda t, s: True)
        df = spark.createDataFrame(batch, ROW)
        ties = TIES if newest else None
        merge_into(table, df, on="id", newest_by=newest, tie_breakers=ties, small_source=small_source)
        stored = brute_merge(stored, batch, same_id, take)
        assert rows(table.read()) == stored
    assert table.meta()["unique"] == unique


def test_merge_rewrites_only_touched_buckets(spark, folder):
    table = Table(spark, folder)
    merge_into(table, spark.range(1000).withColumnRenamed("id", "k"), on="k", buckets=16)
    before = table.meta()["live"]
    merge_into(table, spark.createDataFrame([(3,)], "k long"), on="k")
    after = table.meta()["live"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert table.read().count() == 1000


def test_small_merges_do_not_shuffle_the_target(spark, folder):
    table = Table(spark, folder)
    merge_into(table, spark.range(1000).withColumnRenamed("id", "k"), on="k", buckets=4)
    for i in range(3):
        merge_into(table, spark.createDataFrame([(i,), (2000 + i,)], "k long"), on="k")
    assert table.meta()["thin"] == 3
    assert table.read().count() == 1003
    merge_into(table, spark.createDataFrame([(5,)], "k long"), on="k", small_source=0)
    assert table.meta()["thin"] == 0
    assert table.read().distinct().count() == 1003


def test_merge_into_table_of_other_layout(spark, folder):
    table = Table(spark, folder)
    table.overwrite(spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"))
    merge_into(table, spark.createDataFrame([(2, "x"), (3, "y")], "id long, v string"), on="id")
    assert rows(table.read()) == [(1, "a"), (2, "x"), (3, "y")]
    assert table.meta()["bucket_by"] == ["id"] and table.meta()["unique"]
    source = spark.createDataFrame([(2, "z")], "id long, v string")
    merge_into(table, source, condition="t.id = s.id and t.v <> 'x'")
    assert rows(table.read()) == [(1, "a"), (2, "x"), (2, "z"), (3, "y")]
    assert not table.meta()["unique"]


def test_two_matches_raise(spark, folder):
    target = spark.createDataFrame([(1, "a")], "id long, v string")
    twice = spark.createDataFrame([(1, "x"), (1, "y")], "id long, v string")
    for kwargs in ({"on": "id"}, {"condition": "t.id = s.id and t.v = 'a'"}):
        with pytest.raises(AmbiguousMerge):
            merge_all(target, twice, **kwargs)
    table = Table(spark, folder)
    merge_into(table, target, on="id")
    with pytest.raises(AmbiguousMerge):
        merge_into(table, twice, on="id")
    assert rows(table.read()) == [(1, "a")]


def test_repeated_source_keys_without_match_are_inserted(spark):
    target = spark.createDataFrame([(1, "a")], "id long, v string")
    twice = spark.createDataFrame([(2, "x"), (2, "y")], "id long, v string")
    assert rows(merge_all(target, twice, on="id")) == [(1, "a"), (2, "x"), (2, "y")]


def test_condition_without_equality(spark):
    target = spark.createDataFrame([(1, 5, "a"), (2, 50, "b")], "id long, n long, v string")
    source = spark.createDataFrame([(9, 40, "x")], "id long, n long, v string")
    merged = merge_all(target, source, condition="t.n > s.n", all_pairs=True)
    assert rows(merged) == [(1, 5, "a"), (9, 40, "x")]
    for condition in ("t.n > s.n", "t.n = 5 and s.n > t.n", "t.id = t.n", "t.id + s.id = 3"):
        with pytest.raises(UnboundedMerge):
            merge_all(target, source, condition=condition)
    both = spark.createDataFrame([(9, 40, "x"), (8, 60, None)], "id long, n long, v string")
    merged = merge_all(target, both, condition="t.n > s.n", all_pairs=True)
    assert rows(merged) == [(1, 5, "a"), (8, 60, None), (9, 40, "x")]
    with pytest.raises(AmbiguousMerge):
        merge_all(target, both, condition="t.n < s.n", all_pairs=True)


def test_names_match_in_any_case(spark, folder):
    table = Table(spark, folder)
    first = spark.createDataFrame([(1, "a")], "idThing long, Name string")
    merge_into(table, first, condition="t.idThing = s.idThing")
    for _ in range(2):
        again = spark.createDataFrame([("b", 1)], "name string, IDTHING long")
        merge_into(table, again, condition="t.IDthing = s.idthing")
    assert table.read().columns == ["idThing", "Name"] and rows(table.read()) == [(1, "b")]
    assert table.meta()["bucket_by"] == ["idThing"] and table.meta()["thin"] == 2


def test_equality_keys(spark):
    assert equality_keys("t.id = s.id ") == ["id"]
    assert equality_keys("s.a = t.a AND t.b=s.b") == ["a", "b"]
    assert equality_keys("t.a = s.b") is None
    assert equality_keys("t.a = s.a or t.b = s.b") is None
    assert equality_keys("t.a = s.a and t.b > 3") is None
    assert equality_keys("`t`.`odd name` = s.`odd name`") == ["odd name"]
    found = read_condition("t.a = s.b and (t.c between 1 and 2) and upper(t.d) = s.e")
    assert (found.keys, found.joins, found.plain, found.used) == ([], True, False, {"a", "c", "d"})


def test_align_by_name(spark):
    have = spark.sql("select named_struct('b', 2, 'a', 1) as o, array(named_struct('q', 1)) as l, 1 as id, 9 as more")
    want = spark.sql(
        "select bigint(1) as id, named_struct('a', bigint(0), 'b', bigint(0)) as o,"
        " array(named_struct('q', bigint(1))) as l"
    ).schema
    got = align(have, want).first()
    assert (got.id, got.o.a, got.o.b, got.l[0].q) == (1, 1, 2, 1)
    with pytest.raises(ValueError, match="missing"):
        align(have.drop("id"), want)


def test_upsert_is_idempotent_and_order_free(spark, folder):
    rng = random.Random(3)
    batches = [
        [(rng.randrange(12), "a", ts, f"v{ts}") for ts in rng.sample(range(1000), 10)]
        for _ in range(3)
    ]
    seen = set()
    batches = [[r for r in b if r[2] not in seen and not seen.add(r[2])] for b in batches]
    results = []
    for i, order in enumerate([(0, 1, 2), (2, 1, 0), (1, 1, 2, 0, 0)]):
        table = Table(spark, f"{folder}/{i}")
        for b in order:
            upsert(table, spark.createDataFrame(batches[b], ROW), "id", "ts", NEWEST_WINS)
        results.append(rows(table.read()))
    assert results[0] == results[1] == results[2]
    everything = spark.createDataFrame(sum(batches, []), ROW)
    assert results[0] == rows(latest_per_key(everything, "id", "ts"))


def test_last_batch_overwrites_newer_row_by_default(spark, folder):
    table = Table(spark, folder)
    for ts in (5, 3):
        upsert(table, spark.createDataFrame([(1, "a", ts, f"v{ts}")], ROW), "id", "ts")
    assert rows(table.read()) == [(1, "a", 3, "v3")]


def test_latest_per_key_nulls_and_ties(spark):
    data = [(1, "a", None, "no-ts"), (1, "a", 4, "x"), (1, "b", 4, "y"), (None, "a", 1, "n1"),
            (None, "a", 2, "n2")]
    df = spark.createDataFrame(data, ROW)
    want = [(1, "b", 4, "y"), (None, "a", 2, "n2")]
    assert rows(latest_per_key(df, "id", "ts", "val")) == want
    assert rows(latest_per_key_agg(df, "id", "ts", "val")) == want
    once = rows(latest_per_key(df, "id", "ts"))
    assert once == rows(latest_per_key(df.repartition(5, "val"), "id", "ts"))
    assert once == rows(latest_per_key_agg(df, "id", "ts"))


def test_latest_per_key_cuts_before_the_shuffle(spark, capsys):
    latest_per_key(spark.createDataFrame([(1, "a", 1, "x")], ROW), "id", "ts").explain()
    plan = capsys.readouterr().out
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit")
