import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakestrata.operators.dated import rows_on_day, without_day
from lakestrata.operators.upsert import merge_into
from lakestrata.plans.lakehouse import append_snapshot, delete_day, replace_snapshot
from lakestrata.sources import fs, tables
from lakestrata.sources.tables import Table


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def numbers(spark, *values):
    return spark.createDataFrame([(v, f"v{v}") for v in values], "id long, v string")


def test_versions(spark, folder):
    table = Table(spark, folder)
    assert not table.exists()
    with pytest.raises(FileNotFoundError):
        table.read()
    table.overwrite(numbers(spark, 1, 2))
    first = table.read()
    table.append(numbers(spark, 3))
    assert rows(table.read()) == [(1, "v1"), (2, "v2"), (3, "v3")]
    table.overwrite(table.read().filter("id > 1").select("id"))
    assert rows(table.read()) == [(2,), (3,)]
    assert rows(first) == [(1, "v1"), (2, "v2")]
    with pytest.raises(ValueError, match="schema differs"):
        table.append(numbers(spark, 4))


def test_unfinished_version_is_ignored(spark, folder):
    table = Table(spark, folder)
    table.overwrite(numbers(spark, 1))
    numbers(spark, 9).write.parquet(f"{folder}/_v=00000002")
    assert rows(table.read()) == [(1, "v1")]
    table.overwrite(numbers(spark, 2))
    assert table.meta()["version"] == 3
    assert rows(table.read()) == [(2, "v2")]


def test_empty_tables_keep_their_schema(spark, folder):
    for name, layout in {"a": {}, "b": {"bucket_by": ["id"]}, "c": {"partition_by": "v"}}.items():
        table = Table(spark, f"{folder}/{name}")
        table.overwrite(numbers(spark).filter("id > 0"), **layout)
        assert table.read().columns == ["id", "v"]
        assert table.read().count() == 0
        table.append(numbers(spark, 1))
        assert rows(table.read()) == [(1, "v1")]


def test_replace_stays_in_its_partitions(spark, folder):
    table = Table(spark, folder)
    table.overwrite(numbers(spark, 1, 2, 3), partition_by="v")
    table.replace(numbers(spark, 2, 2), ["v=v2", "v=v3"])
    assert rows(table.read()) == [(1, "v1"), (2, "v2"), (2, "v2")]
    with pytest.raises(ValueError, match="outside"):
        table.replace(numbers(spark, 1), ["v=v2"])
    assert table.read().count() == 3
    table.drop(["v=v1"])
    assert rows(table.read()) == [(2, "v2"), (2, "v2")]


def test_other_writer_is_noticed(spark, folder):
    table = Table(spark, folder)
    table.overwrite(numbers(spark, 1))
    stale = table.meta()
    table.append(numbers(spark, 2))
    with pytest.raises(RuntimeError, match="another writer"):
        table._commit(numbers(spark, 3), table.schema, {**stale}, stale, [])
    assert table.read().count() == 2


def test_purge_keeps_what_newer_versions_use(spark, folder):
    table = Table(spark, folder)
    table.overwrite(numbers(spark, 1, 2, 3), partition_by="v")
    for _ in range(3):
        table.replace(numbers(spark, 2), ["v=v2"])
    want = rows(table.read())
    table.purge(keep=1)
    assert rows(table.read()) == want
    left = [n for n in fs.names(spark, f"{folder}/_v=00000001") if n.startswith("v=")]
    assert left == ["v=v1", "v=v3"]
    assert fs.names(spark, folder) == ["_v=00000001", "_v=00000004"]


def test_null_keys_are_spread_over_buckets(spark, folder):
    table = Table(spark, folder)
    df = spark.range(400).select(F.lit(None).cast("long").alias("k"), F.col("id").alias("v"))
    table.overwrite(df, bucket_by=["k"], buckets=4)
    assert len(table.meta()["live"]) == 4
    assert table.read().count() == 400


def test_buckets_follow_the_size(spark, folder):
    table = Table(spark, folder)
    table.overwrite(spark.range(50_000).withColumnRenamed("id", "k"), bucket_by=["k"], unique=True)
    meta = table.meta()
    assert meta["buckets"] == 1 and meta["bytes"] > 50_000
    assert table.buckets_wanted() == 1
    assert table.buckets_wanted(meta["bytes"] // 3) == 1
    assert table.buckets_wanted(meta["bytes"] // 5) == 8
    assert table.buckets_wanted(meta["bytes"] // 20) == 32


def test_merges_raise_the_number_of_buckets(spark, folder, monkeypatch):
    table = Table(spark, folder)
    merge_into(table, spark.range(50_000).withColumnRenamed("id", "k"), on="k")
    small = table.meta()["bytes"] // 6
    wanted = Table.buckets_wanted
    monkeypatch.setattr(Table, "buckets_wanted", lambda self: wanted(self, small))
    for step in range(3):
        merge_into(table, spark.range(step, step + 1).withColumnRenamed("id", "k"), on="k")
        meta = table.meta()
        assert (meta["buckets"], meta["unique"]) == (8, True)
        assert len({v for vs in meta["live"].values() for v in vs}) == 1 + step
    assert table.read().distinct().count() == table.read().count() == 50_000
    merge_into(table, spark.range(5).withColumnRenamed("id", "k"), on="k", buckets=2)
    assert table.meta()["buckets"] == 2
    assert table.read().distinct().count() == table.read().count() == 50_000


def test_merges_on_more_than_keys_raise_it_too(spark, folder, monkeypatch):
    table = Table(spark, folder)
    rows_ = spark.range(50_000).select(F.col("id").alias("k"), F.lit(1).alias("f"))
    merge_into(table, rows_, condition="t.k = s.k AND s.f >= t.f")
    small = table.meta()["bytes"] // 6
    wanted = Table.buckets_wanted
    monkeypatch.setattr(Table, "buckets_wanted", lambda self: wanted(self, small))
    for step in range(2):
        merge_into(table, rows_.filter(f"k = {step}").withColumn("f", F.lit(2)), condition="t.k = s.k AND s.f >= t.f")
        assert table.meta()["buckets"] == 8
    assert table.read().count() == 50_000 and table.read().filter("f = 2").count() == 2


def test_keys_in_either_order_touch_the_same_buckets(spark, folder):
    table = Table(spark, folder)
    both = spark.range(1000).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"), F.lit("old").alias("v"))
    merge_into(table, both, condition="t.a = s.a AND t.b = s.b", buckets=8)
    for condition in ("t.b = s.b AND t.a = s.a", "t.b = s.b AND t.a = s.a AND s.v <> 'none'"):
        before = table.meta()["live"]
        merge_into(table, both.filter("a = 7").withColumn("v", F.lit(condition)), condition=condition)
        after = table.meta()["live"]
        assert table.meta()["bucket_by"] == ["a", "b"] and sum(before[p] != after[p] for p in before) == 1
    assert table.read().count() == 1000 and table.read().filter("v = 'old'").count() == 999


def test_a_first_load_that_grows_on_the_way_gets_its_buckets(spark, folder, monkeypatch):
    monkeypatch.setattr(tables, "BUCKET_BYTES", 20_000)
    spark.range(10).write.parquet(f"{folder}/small")
    grown = spark.read.parquet(f"{folder}/small").select(F.explode(F.sequence(F.col("id") * 10_000, F.col("id") * 10_000 + 9_999)).alias("k"))
    table = Table(spark, f"{folder}/table")
    merge_into(table, grown, on="k")
    meta = table.meta()
    assert meta["buckets"] >= 8 and meta["unique"] and len(meta["live"]) == meta["buckets"]
    assert table.read().distinct().count() == table.read().count() == 100_000


def test_snapshots(spark, folder):
    table = Table(spark, folder)
    one, two = "2024-10-04", "2024-10-05"
    replace_snapshot(table, numbers(spark, 1), one)
    replace_snapshot(table, numbers(spark, 5), two)
    kept = table.meta()["live"][f"snapshot_date={two}"]
    replace_snapshot(table, numbers(spark, 1, 2), dt.date(2024, 10, 4))
    assert rows(table.read().drop("snapshot_date")) == [(1, "v1"), (2, "v2"), (5, "v5")]
    assert table.meta()["live"][f"snapshot_date={two}"] == kept
    append_snapshot(table, numbers(spark, 2), one)
    assert table.read().filter(F.col("snapshot_date") == one).count() == 3
    replace_snapshot(table, numbers(spark), one)
    assert rows(table.read().drop("snapshot_date")) == [(5, "v5")]
    replace_snapshot(table, numbers(spark, 7), one, new_table=True)
    assert rows(table.read().drop("snapshot_date")) == [(7, "v7")]
    for bad in (None, "today", ""):
        with pytest.raises((ValueError, TypeError)):
            replace_snapshot(table, numbers(spark, 1), bad)


def test_reading_one_snapshot_prunes_the_others(spark, folder, capsys):
    table = Table(spark, folder)
    replace_snapshot(table, numbers(spark, 1), "2024-10-04")
    table.read().filter("snapshot_date = date'2024-10-04'").explain()
    assert "PartitionFilters: [isnotnull(snapshot_date" in capsys.readouterr().out


STAMPS = ["2024-10-04 00:00:00", "2024-10-04 23:59:59", "2024-10-05 00:00:00", None]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "string"])
@pytest.mark.parametrize("layout", [{}, {"bucket_by": ["id"]}])
def test_delete_day(spark, folder, kind, layout):
    table = Table(spark, folder)
    data = spark.createDataFrame(list(enumerate(STAMPS)), "id int, ts string")
    typed = data.withColumn("ts", F.col("ts").cast("timestamp").cast(kind))
    table.overwrite(typed if kind != "string" else data, **layout)
    assert delete_day(table, "ts", "2024-10-04") == 2
    assert sorted(r.id for r in table.read().collect()) == [2, 3]
    version = table.meta()["version"]
    assert delete_day(table, "ts", "2024-10-04") == 0
    assert table.meta()["version"] == version
    with pytest.raises((ValueError, TypeError)):
        delete_day(table, "ts", None)


def test_delete_day_of_snapshots(spark, folder):
    table = Table(spark, folder)
    for day in ("2024-10-04", "2024-10-05"):
        replace_snapshot(table, numbers(spark, 1, 2), day)
    assert delete_day(table, "snapshot_date", "2024-10-04") == 2
    assert list(table.meta()["live"]) == ["snapshot_date=2024-10-05"]
    assert table.read().count() == 2


def test_day_filter_is_pushed_down(spark, capsys):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows_on_day(events, "ts", "2024-01-10").explain()
    assert "GreaterThanOrEqual(ts" in capsys.readouterr().out
    without_day(events, "ts", "2024-01-10").explain()
    assert "PushedFilters: [Or(Or(LessThan(ts" in capsys.readouterr().out


def test_a_day_is_deleted_file_by_file(spark, folder):
    """Of many files in order of time only those with the day are rewritten, also a second time and beside NULLs."""
    day = F.expr("DATE'2024-01-01' + CAST(id / 100 AS INT)")
    events = spark.range(1000).select("id", F.when(F.col("id") != 550, day).alias("d"))
    table = Table(spark, folder)
    table.overwrite(events.repartitionByRange(10, "id"))
    first = set(table.read().inputFiles())
    old = table.read()
    assert delete_day(table, "d", "2024-01-06") == 99
    left = set(table.read().inputFiles())
    assert len(first - left) in (1, 2) and len(left & first) >= 8
    assert table.read().count() == 901 and old.count() == 1000
    assert delete_day(table, "d", "2024-01-06") == 0
    assert delete_day(table, "d", "2024-01-07") == 100
    assert rows(table.read()) == rows(events.filter("d IS NULL OR d NOT IN (DATE'2024-01-06', DATE'2024-01-07')"))
    table.append(events.filter("id < 3"))
    table.purge(1)
    assert table.read().count() == 804
    table.overwrite(events)
    assert table.meta()["without"] == {} and table.read().count() == 1000


def test_a_day_is_deleted_file_by_file_in_other_partitions(spark, folder):
    events = spark.range(60).select("id", F.concat(F.lit("a b="), F.col("id") % 3).alias("part"), F.expr("DATE'2024-01-01' + CAST(id / 20 AS INT)").alias("d"))
    table = Table(spark, folder)
    table.overwrite(events.repartition(1), partition_by="part")
    assert delete_day(table, "d", "2024-01-02") == 20
    assert rows(table.read()) == rows(events.filter("d <> DATE'2024-01-02'").select(*table.schema.names))
