"""Inputs that used to be answered wrongly without a word: types, names, ties, sizes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakestrata.operators.latest import latest_per_key, latest_per_key_agg
from lakestrata.operators.merge import NEWEST_WINS, merge_all, merge_unique
from lakestrata.operators.shape import explode_bridge
from lakestrata.operators.upsert import merge_into, upsert
from lakestrata.plans.lakehouse import delete_day
from lakestrata.sources.landing import land_batch
from lakestrata.sources.tables import Table


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize(
    "source", ["4294967297L AS id, 'x' AS v", "1.5D AS id, 'x' AS v", "'x9' AS id, 'x' AS v"]
)
def test_keys_are_never_cut(spark, source, ansi):
    target = spark.sql("SELECT 1 AS id, 'a' AS v")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="value is no int"):
            merge_all(target, spark.sql(f"SELECT {source}"), on="id").collect()
        fits = merge_all(target, spark.sql("SELECT 1L AS id, 'b' AS v UNION ALL SELECT 2L, 'c'"), on="id")
        assert rows(fits) == [(1, "b"), (2, "c")]
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_widened_keys(spark):
    target = spark.sql("SELECT 1 AS id, 'a' AS v")
    source = spark.sql("SELECT 4294967297L AS id, 'x' AS v UNION ALL SELECT 1L, 'b'")
    assert rows(merge_all(target, source, on="id", widen=True)) == [(1, "b"), (4294967297, "x")]


def test_names_of_the_user(spark, folder):
    target = spark.createDataFrame([(1, False, 1), (2, False, 1)], "k long, _hit boolean, _rank int")
    source = spark.createDataFrame([(1, True, 2), (3, True, 2)], "k long, _hit boolean, _rank int")
    want = [(1, True, 2), (2, False, 1), (3, True, 2)]
    assert rows(merge_all(target, source, on="k")) == want
    assert rows(merge_all(target, source, condition="t.k = s.k AND s._rank > t._rank")) == want
    assert rows(merge_unique(target, source, "k", newest_by="_rank")) == want
    df = spark.createDataFrame([(1, 5, 7), (1, 6, 8)], "k long, _rn int, _row int")
    assert rows(latest_per_key(df, "k", "_rn")) == rows(latest_per_key_agg(df, "k", "_rn")) == [(1, 6, 8)]
    links = spark.createDataFrame([(1, ["h/7"], "keep")], "id long, urls array<string>, _id string")
    assert rows(explode_bridge(links, "id", "urls", "a", "b", {"_id": "c"})) == [(1, "7", "keep")]
    for name in ("_v", "_bucket", "_V"):
        with pytest.raises(ValueError, match="needs the names"):
            Table(spark, folder).overwrite(spark.range(1).withColumnRenamed("id", name), bucket_by=[name])
    table = Table(spark, folder)
    table.overwrite(spark.range(3).withColumnRenamed("id", "_bucket"))
    assert rows(table.read()) == [(0,), (1,), (2,)]


def test_ties_do_not_depend_on_partitions_or_order(spark, folder):
    data = [(1, 5, 0, f"v{i}", {"a": i}) for i in range(40)]
    df = spark.createDataFrame(data, "k long, ts long, tie long, v string, m map<string, int>")
    winners = {
        rows(latest(df.repartition(n, "v"), "k", "ts", "tie").select("v"))[0]
        for latest in (latest_per_key, latest_per_key_agg)
        for n in (1, 2, 3, 7)
    }
    assert len(winners) == 1
    batches = [df.drop("m").filter(F.col("v") == v) for v in ("v1", "v2", "v3")]
    for small in (True, False):
        ends = set()
        for i, order in enumerate([(0, 1, 2), (2, 1, 0), (1, 0, 2)]):
            table = Table(spark, f"{folder}/{small}{i}")
            for b in order:
                if small:
                    upsert(table, batches[b], "k", "ts", NEWEST_WINS, "tie")
                else:
                    merge_into(table, batches[b], on="k", newest_by="ts", tie_breakers="tie", small_source=0)
            ends.add(table.read().first().v)
        assert len(ends) == 1


def test_landed_timestamps_keep_microseconds(spark, folder):
    stamp = dt.datetime(2024, 1, 2, 3, 4, 5, 123456)
    df = spark.createDataFrame([(1, stamp, stamp)], "id long, a timestamp, b timestamp_ntz")
    for i, lines in enumerate((False, True)):
        path = land_batch(df, f"{folder}/{i}", "2024-01-02", array_lines=lines)
        assert rows(spark.read.schema(df.schema).json(path)) == rows(df)


def test_size_alone_gives_the_buckets(spark):
    per = 512 * 1024 * 1024
    assert [Table.buckets_for(n) for n in (0, 1, per, per + 1, 5 * per)] == [1, 1, 1, 2, 8]
    assert Table.buckets_for(100 * 10**12) == 262_144


@pytest.mark.parametrize("partitions", ["5", "200"])
def test_small_merge_after_a_large_first_load(spark, folder, partitions, monkeypatch):
    """The first write sees how much there is, so that the next, small merge rewrites little."""
    monkeypatch.setattr("lakestrata.sources.tables.BUCKET_BYTES", 20_000)
    many = spark.range(40_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    many.write.parquet(f"{folder}/rows")
    table = Table(spark, f"{folder}/table")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        upsert(table, spark.read.parquet(f"{folder}/rows"), "k", "v")
        first = table.meta()
        assert first["buckets"] >= 64
        merge_into(table, spark.createDataFrame([(1, "a"), (2, "b"), (-1, "c")], "k long, v string"), on="k")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    after = table.meta()
    assert after["buckets"] == first["buckets"]
    assert 1 <= sum(after["live"][b] != v for b, v in first["live"].items()) <= 3


def test_predicate_merge_and_delete_touch_few_buckets(spark, folder):
    table = Table(spark, folder)
    data = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 50).alias("ts"))
    table.overwrite(data.withColumn("day", F.lit("2024-01-01")), bucket_by=["k"], buckets=16, unique=True)
    before = table.meta()["live"]
    source = spark.createDataFrame([(3, 99, "2024-01-02"), (4, 0, "2024-01-02")], "k long, ts long, day string")
    merge_into(table, source, condition="t.k = s.k AND s.ts > t.ts")
    after = table.meta()["live"]
    assert sum(before[b] != after[b] for b in before) <= 2
    got = rows(table.read().filter("k IN (3, 4)"))
    assert got == [(3, 99, "2024-01-02"), (4, 0, "2024-01-02"), (4, 4, "2024-01-01")]
    assert delete_day(table, "day", "2024-01-02") == 2
    assert sum(after[b] != v for b, v in table.meta()["live"].items()) <= 2
    assert table.read().count() == 999


def test_two_writers_land_at_once(spark, folder):
    """Every writer is given a number of its own, and all rows land."""
    from concurrent.futures import ThreadPoolExecutor

    from lakestrata.sources.landing import claim_batch, land_batch

    frames = [spark.range(50 * i, 50 * i + 50) for i in range(8)]
    with ThreadPoolExecutor(8) as pool:
        targets = list(pool.map(lambda df: land_batch(df, folder, "2024-10-04"), frames))
    assert sorted(t.rsplit("_", 1)[1] for t in targets) == [f"{i:03d}.json" for i in range(1, 9)]
    assert spark.read.schema("id bigint").json(f"{folder}/*.json").distinct().count() == 400
    with ThreadPoolExecutor(16) as pool:
        names = list(pool.map(lambda _: claim_batch(spark, folder, "2024-10-05"), range(40)))
    assert len(set(names)) == 40
    assert claim_batch(spark, folder, "2024-10-04") == "2024-10-04_009.json"


def test_a_write_between_two_reads_is_not_lost(spark, folder):
    """Bronze grows while silver is on its way: the next run finds what this one did not read."""
    from lakestrata.plans import lakehouse
    from lakestrata.plans.lakehouse import Lakehouse
    from lakestrata.sources import fs

    house = Lakehouse(spark, folder)
    fs.write_text(spark, f"{folder}/sql/thing.sql", "SELECT k, v FROM shop_thing")
    house.upsert(spark.createDataFrame([(1, 1, "a")], "k long, ts long, v string"), "shop", "thing", "k", "ts", buckets=4)
    run = lakehouse.run_sql_file

    def slow(*args, **kwargs):
        lakehouse.run_sql_file = run
        found = run(*args, **kwargs)
        house.upsert(spark.createDataFrame([(2, 1, "b")], "k long, ts long, v string"), "shop", "thing", "k", "ts")
        return found

    lakehouse.run_sql_file = slow
    try:
        for _ in range(2):
            house.to_silver(f"{folder}/sql/thing.sql", "shop", "thing", "t.k = s.k", incremental=True)
    finally:
        lakehouse.run_sql_file = run
    assert sorted(tuple(r) for r in house.load("silver", "shop", "thing").collect()) == [(1, "a"), (2, "b")]
