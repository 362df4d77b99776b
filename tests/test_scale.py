"""Plans and file layouts that have to hold at size: pruning, shuffles, hot keys."""

import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from lakestrata.functions import plans
from lakestrata.functions.plans import comes_from_shuffle_on
from lakestrata.operators import merge
from lakestrata.operators import upsert as upserts
from lakestrata.operators.latest import latest_per_key
from lakestrata.operators.merge import kept_rows, merge_all, without_stale
from lakestrata.operators.shape import count_by
from lakestrata.operators.upsert import merge_into, upsert
from lakestrata.plans import catalog
from lakestrata.sources import fs, tables
from lakestrata.sources.files import ARRIVED, ARRIVED_FILE, arrived_together
from lakestrata.sources.tables import Table
from lakestrata.streaming.cdc import start_cdc

EVENTS = "/root/testdata/sf0.01/events.parquet"


def plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def shuffles(text):
    return len(re.findall(r"(?<!Broadcast)Exchange (hash|range|Round|single)", text))


def test_small_source_leaves_the_target_unshuffled(spark, capsys):
    events = spark.read.parquet(EVENTS)
    text = plan(kept_rows(events, events.limit(5), ["user_id"], small=True), capsys)
    target_side = text[: text.index("BroadcastExchange")]
    assert "BroadcastHashJoin" in text and shuffles(target_side) == 0


def test_stale_check_reads_keys_and_order_only(spark, capsys):
    events = spark.read.parquet(EVENTS)
    text = plan(without_stale(events, events.limit(5), ["user_id"], ["ts"], []), capsys)
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in text


def test_matches_are_found_by_keys_only(spark, capsys):
    events = spark.read.parquet(EVENTS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(merge_all(events, events, on="user_id", check=False), capsys)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ReadSchema: struct<user_id:bigint>" in text
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_counts_are_partial_before_the_shuffle(spark, capsys):
    events = spark.read.parquet(EVENTS)
    text = plan(count_by(events, "n", kind=F.col("event_type")), capsys)
    assert "partial_count" in text and "ReadSchema: struct<event_type:string>" in text


def test_rows_of_a_landed_batch_do_not_meet_by_its_name(spark, capsys):
    names = F.concat(F.lit("/raw/2024-10-04_"), F.col("id") % 2, F.lit(".json")).alias(ARRIVED_FILE)
    rows = spark.range(1000).select("id", F.timestamp_seconds("id").alias(ARRIVED), names)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        together = arrived_together(rows)
        text = plan(together, capsys)
        found = together.groupBy(ARRIVED_FILE).agg(F.min(ARRIVED) == F.max(ARRIVED), F.count("*"))
        assert [tuple(r)[1:] for r in found.collect()] == [(True, 500)] * 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "ShuffledHashJoin" not in text


def test_touched_buckets_are_the_only_ones_read(spark, folder):
    table = Table(spark, folder)
    table.overwrite(spark.read.parquet(EVENTS), bucket_by=["event_id"], buckets=10)
    files = table.read(["_bucket=3", "_bucket=7"]).inputFiles()
    assert {re.search(r"_bucket=(\d+)", f).group(1) for f in files} == {"3", "7"}


@pytest.mark.parametrize("buckets", [8, 4, 16, 5])
@pytest.mark.parametrize("policy", ["last_batch_wins", "newest_wins"])
def test_shuffle_on_keys_serves_the_buckets(spark, folder, buckets, policy):
    """Batch and merge shuffle on the keys; as many buckets need no further shuffle, other numbers a
    rebalance, and every bucket ends in one or two files either way."""
    spark.range(20_000).select(F.col("id").alias("k"), F.col("id").alias("ts")).write.parquet(
        f"{folder}/rows"
    )
    rows, table = spark.read.parquet(f"{folder}/rows"), Table(spark, f"{folder}/table")

    def check_files():
        version = table._folder(table.meta()["version"])
        for bucket in table.meta()["live"]:
            names = fs.names(spark, f"{version}/{bucket}")
            files = [n for n in names if n.endswith(".parquet")]
            assert len(files) <= 2 * max(1, 8 // buckets)

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        upsert(table, rows, "k", "ts", policy, "ts", buckets=buckets)
        assert table.shuffles_fit() == (buckets != 5)
        check_files()
        for _ in range(2):
            change = rows.filter("k > 5000").withColumn("k", F.col("k") + 10_000)
            latest = latest_per_key(change, "k", "ts", "ts")
            newest = "ts" if policy == "newest_wins" else None
            merge_into(table, latest, on="k", newest_by=newest, source_unique=True, small_source=0)
            check_files()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert table.read().count() == 30_000
    assert table.read().select("k").distinct().count() == 30_000


def test_only_sparks_own_shuffle_on_the_keys_places_rows(spark, folder):
    rows = spark.range(20_000).select(F.col("id").alias("k"), F.col("id").alias("ts"))
    rows.write.parquet(f"{folder}/rows")
    read = spark.read.parquet(f"{folder}/rows")
    cases = {
        True: [read, read.groupBy("k").agg(F.max("ts").alias("ts"))],
        False: [rows, read.repartition(3, "k"), read.repartitionByRange(5, "k"), read.orderBy("k")],
    }
    for fits, batches in cases.items():
        for batch in batches:
            assert comes_from_shuffle_on(latest_per_key(batch, "k", "ts", "ts"), ["k"]) == fits
    assert not comes_from_shuffle_on(latest_per_key(read, "k", "ts", "ts"), ["ts"])
    table = Table(spark, f"{folder}/table")
    upsert(table, rows, "k", "ts", buckets=16)
    assert len(table.read().inputFiles()) == 16


def test_hot_key_is_written_by_several_tasks(spark, folder):
    """A third of all rows under one key: its bucket is split, and a merge updates all of them."""
    rows = spark.range(90_000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"),
        F.sha2(F.col("id").cast("string"), 256).alias("v"),
    )
    table = Table(spark, folder)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "256k")
    try:
        table.overwrite(rows.repartition(16), bucket_by=["k"], buckets=4)
        hot = table.bucketed(spark.createDataFrame([(-1, "")], table.schema)).first()["_bucket"]

        def files(bucket):
            names = fs.names(spark, f"{table._folder(table.meta()['version'])}/_bucket={bucket}")
            return len([n for n in names if n.endswith(".parquet")])

        assert files(hot) > 3
        change = spark.createDataFrame([(-1, "new"), (-2, "more")], "k long, v string")
        merge_into(table, change, on="k")
        assert files(hot) > 1
    finally:
        for key in ("advisoryPartitionSizeInBytes", "skewJoin.skewedPartitionThresholdInBytes"):
            spark.conf.unset(f"spark.sql.adaptive.{key}")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert table.read().count() == 90_001
    assert table.read().filter("v = 'new'").count() == 30_000


def test_rows_that_compress_well_are_dealt_over_many_tasks(spark, folder, monkeypatch):
    """One bucket read by one task, then a merge that matches repeated keys: no task writes many of the rows."""
    for module in (plans, tables):
        monkeypatch.setattr(module, "TASK_ROWS", 10_000, raising=False)
    monkeypatch.setattr(plans, "_FEW_BYTES", 0, raising=False)
    stored = spark.range(200_000).select(F.floor(F.col("id") / 4).alias("k"), F.lit("O").alias("v"))
    stored.coalesce(1).write.parquet(f"{folder}/rows {{1}}")
    table = Table(spark, f"{folder}/table")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = dict(spark.conf.getAll)

    def most():
        file = F.col("_metadata.file_path")
        meta = table.meta()
        rows = table._scan(meta, table._paths(meta, meta["live"]))
        return rows.groupBy(file.alias("file")).count().agg(F.max("count")).first()[0]

    try:
        table.overwrite(spark.read.parquet(f"{folder}/rows {{1}}".replace("{", "\\{").replace("}", "\\}")), ["k"])
        assert most() < 60_000
        change = spark.range(40_000, 60_000).select(F.col("id").alias("k"), F.lit("DONE").alias("v"))
        merge_into(table, change, on="k", small_source=0)
        assert most() < 60_000
        assert dict(spark.conf.getAll) == before
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    counts = {r.v: (r.n, r.keys) for r in table.read().groupBy("v").agg(F.count("*").alias("n"), F.countDistinct("k").alias("keys")).collect()}
    assert counts == {"O": (160_000, 40_000), "DONE": (50_000, 20_000)}


def test_joins_of_many_rows_make_tasks_by_rows(spark, folder, monkeypatch):
    monkeypatch.setattr(plans, "TASK_ROWS", 10_000, raising=False)
    monkeypatch.setattr(plans, "_FEW_BYTES", 0, raising=False)
    spark.range(200_000).select(F.col("id").alias("k"), F.lit("O").alias("v")).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    changes = {"minPartitionSize": "1k", "parallelismFirst": "false"}
    for key, value in changes.items():
        spark.conf.set(f"spark.sql.adaptive.coalescePartitions.{key}", value)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = dict(spark.conf.getAll)
    try:
        merged = merge_all(rows, rows, on="k", check=False)
        assert plans.rows_read(merged) == 200_000
        with plans.dealt_by_rows(spark, 200_000):
            with plans.dealt_by_rows(spark, 50_000):
                pass
            sizes = kept_rows(rows, rows.filter("k < 100"), ["k"]).groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in sizes) < 50_000
        assert dict(spark.conf.getAll) == before
    finally:
        for key in changes:
            spark.conf.unset(f"spark.sql.adaptive.coalescePartitions.{key}")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_key_batches_and_null_keys(spark, folder):
    """Half of a batch under one key and a third without any key."""
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 3 == 0, F.col("id")).alias("k"),
        F.col("id").alias("ts"),
    )
    table = Table(spark, folder)
    upsert(table, rows.filter("ts < 30000"), "k", "ts")
    upsert(table, rows, "k", "ts", policy="newest_wins")
    got = table.read()
    assert got.filter("k = 1").first().ts == 59_998
    assert got.filter("k is null").count() == 2
    want = latest_per_key(rows.filter("k is not null"), "k", "ts")
    assert got.filter("k is not null").exceptAll(want).count() == 0
    assert got.filter("k is not null").count() == want.count()


def test_a_merge_for_each_file_rewrites_one_bucket(spark, monkeypatch):
    folder, name = "/root/testdata/sf0.001", "cdc_stream_one_file_per_trigger"
    monkeypatch.setattr(catalog, "FILE_BYTES", Path(f"{folder}/events.parquet").stat().st_size // 2 + 1, raising=False)
    got = catalog.queries()[name](spark, folder)
    sql = catalog.oracle_sql()[name].replace("FROM events", f"FROM '{folder}/events.parquet' AS events")
    assert sorted(r.event_id for r in got.collect()) == sorted(r[0] for r in duckdb.sql(sql).fetchall())
    written = [re.search(r"(.*/_v=\d+)/_bucket=(\d+)/", f).groups() for f in got.inputFiles()]
    root = written[0][0].rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:")
    versions = [p for p in Path(root).iterdir() if p.name.startswith("_v=")]
    assert len({bucket for _, bucket in written}) == 2 and len(versions) > 4
    assert all(len(list(p.glob("_bucket=*"))) <= 1 for p in versions)


@pytest.mark.parametrize("streamed", [True, False])
def test_text_rows_are_ranked_by_many_tasks(spark, folder, monkeypatch, streamed):
    """A first batch of JSON and a second one, however few the shuffle partitions of the session."""
    for module in (plans, tables):
        monkeypatch.setattr(module, "TASK_ROWS", 2_000, raising=False)
    monkeypatch.setattr(plans, "_FEW_BYTES", 0, raising=False)
    monkeypatch.setattr(plans, "ROW_BYTES", 16, raising=False)
    table, raw, most = Table(spark, f"{folder}/table"), f"{folder}/{{raw}}", []

    def add(first):
        ids = spark.range(first, first + 40_000)
        rows = ids.select((F.col("id") % 40_000).alias("k"), F.col("id").alias("ts"))
        path = f"{raw}/{first}.json"
        rows.coalesce(2).write.json(path)
        if streamed:
            stream = start_cdc(spark, raw.replace("{", "\\{").replace("}", "\\}"), table, f"{folder}/seen", "k", "ts", "k long, ts long", buckets=8)
            stream.awaitTermination()
        else:
            escaped = path.replace("{", "\\{").replace("}", "\\}")
            upsert(table, spark.read.schema("k long, ts long").json(escaped), "k", "ts", buckets=8)

    def sizes(rows, *rest):
        most.append(rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
        return bucket_sizes(rows, *rest)

    bucket_sizes = upserts._bucket_sizes
    monkeypatch.setattr(upserts, "_bucket_sizes", sizes)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
    before = dict(spark.conf.getAll)
    try:
        add(0)
        meta = table.meta()
        stored = table._scan(meta, table._paths(meta, meta["live"]))
        files = stored.groupBy(F.col("_metadata.file_path").alias("file")).count()
        assert files.agg(F.max("count")).first()[0] < 2_500
        add(40_000)
        assert most and max(most) < 2_500
        assert dict(spark.conf.getAll) == before
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    assert table.read().filter("ts = k + 40000").count() == table.read().select("k").distinct().count() == 40_000


def test_keys_are_checked_by_many_tasks(spark, folder, monkeypatch):
    """The first merge of a stored table's rows: neither its scan nor its shuffle brings many rows into one task."""
    monkeypatch.setattr(plans, "TASK_ROWS", 2_000, raising=False)
    monkeypatch.setattr(plans, "_FEW_BYTES", 0, raising=False)
    spark.range(40_000).select(F.col("id").alias("k")).repartition(40).write.parquet(f"{folder}/rows")
    most = []

    def repeated(rows, keys):
        for part in (rows, rows.groupBy(*keys).count()):
            most.append(part.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
        return repeated_keys(rows, keys)

    repeated_keys = merge.repeated_keys
    monkeypatch.setattr(merge, "repeated_keys", repeated)
    changes = {"adaptive.coalescePartitions.minPartitionSize": "1k", "files.openCostInBytes": "1"}
    for key, value in changes.items():
        spark.conf.set(f"spark.sql.{key}", value)
    try:
        merge_into(Table(spark, f"{folder}/table"), spark.read.parquet(f"{folder}/rows"), condition="t.k = s.k")
    finally:
        for key in changes:
            spark.conf.unset(f"spark.sql.{key}")
    assert len(most) == 2 and max(most) < 4_000
    assert Table(spark, f"{folder}/table").read().count() == 40_000
