"""Streams, layers and workflows on small raw folders."""

import json
import os
from contextlib import contextmanager

import pytest

from lakestrata import Lakehouse, Layout
from lakestrata.operators.merge import NEWEST_WINS
from lakestrata.plans import config
from lakestrata.plans.catalog import _WORKFLOW
from lakestrata.session import DEFAULTS
from lakestrata.sources import fs

RAW_ROWS = {
    1: [{"id": 1, "name": "a", "updated_at": "2024-10-04T10", "urls": ["h/1", "h/2"]}],
    2: [{"id": 1, "name": "b", "updated_at": "2024-10-04T09", "urls": []},
        {"id": 2, "name": "c", "updated_at": "2024-10-04T09", "urls": ["h/7"]}],
    3: [{"id": 2, "name": "d", "updated_at": "2024-10-04T11", "urls": ["h/8"]},
        {"id": 2, "name": "e", "updated_at": "2024-10-04T12", "urls": ["h/9"]},
        {"id": None, "name": "n", "updated_at": "2024-10-04T12", "urls": None}],
}


def drop_file(root, number, rows, age=0, name=None):
    folder = root / "raw" / "s" / "thing"
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / (name or f"2024-10-04_{number:03d}.json")
    path.write_text(json.dumps(rows))
    when = 1_700_000_000 + number * 10 - age
    os.utime(path, (when, when))


def state(house):
    df = house.load("bronze", "s", "thing")
    return sorted([(r.id, r.name) for r in df.collect()], key=repr)


@pytest.mark.parametrize("files", [1, 2, None])
def test_last_batch_wins_whatever_the_batch_size(spark, tmp_path, files):
    for number, rows in RAW_ROWS.items():
        drop_file(tmp_path, number, rows)
    house = Lakehouse(spark, str(tmp_path))
    house.bronze_cdc("s", "thing", "id", "updated_at", max_files_per_trigger=files)
    assert state(house) == [(1, "b"), (2, "e"), (None, "n")]


@pytest.mark.parametrize("files", [1, None])
def test_file_time_beats_file_name(spark, tmp_path, files):
    drop_file(tmp_path, 1, [{"id": 1, "name": "late", "updated_at": "1"}])
    drop_file(tmp_path, 2, [{"id": 1, "name": "early", "updated_at": "2"}], age=100)
    house = Lakehouse(spark, str(tmp_path))
    house.bronze_cdc("s", "thing", "id", "updated_at", max_files_per_trigger=files)
    assert state(house) == [(1, "late")]


def test_newest_wins_and_reruns(spark, tmp_path):
    house = Lakehouse(spark, str(tmp_path))

    def run():
        house.bronze_cdc("s", "thing", "id", "updated_at", policy=NEWEST_WINS)

    drop_file(tmp_path, 1, RAW_ROWS[1])
    run()
    version = house.table("bronze", "s", "thing").meta()["version"]
    run()
    assert house.table("bronze", "s", "thing").meta()["version"] == version
    drop_file(tmp_path, 2, RAW_ROWS[2])
    drop_file(tmp_path, 3, RAW_ROWS[3])
    run()
    assert state(house) == [(1, "a"), (2, "e"), (None, "n")]


def test_replayed_batch_is_not_merged_twice(spark, tmp_path):
    """A driver lost after the merge but before the checkpoint: the same files come again."""
    house = Lakehouse(spark, str(tmp_path))
    commits = f"{tmp_path}/checkpoints/s/thing_checkpoint/commits"
    drop_file(tmp_path, 3, RAW_ROWS[3])
    house.bronze_cdc("s", "thing", "id", "updated_at")
    drop_file(tmp_path, 4, [{**RAW_ROWS[3][2], "name": "m"}, *RAW_ROWS[1]])
    house.bronze_cdc("s", "thing", "id", "updated_at")
    want = [(1, "a"), (2, "e"), (None, "m"), (None, "n")]
    assert state(house) == want
    version = house.table("bronze", "s", "thing").meta()["version"]
    fs.delete(spark, f"{commits}/1")
    fs.delete(spark, f"{commits}/.1.crc")
    house.bronze_cdc("s", "thing", "id", "updated_at")
    assert fs.exists(spark, f"{commits}/1")
    assert state(house) == want
    assert house.table("bronze", "s", "thing").meta()["version"] == version


def test_landed_batches_arrive_whole(spark, tmp_path):
    """Parts of one landed batch rank by timestamp among themselves, batches by number."""
    house = Lakehouse(spark, str(tmp_path))
    rows = [(i % 5, i, f"v{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, ts long, name string").repartition(6)
    house.land(df, "s", "thing", "2024-10-04T10:00:00")
    again = spark.createDataFrame([(0, 1, "second")], "id long, ts long, name string")
    house.land(again, "s", "thing", "2024-10-04T11:00:00")
    house.bronze_cdc("s", "thing", "id", "ts")
    assert state(house) == [(0, "second"), (1, "v36"), (2, "v37"), (3, "v38"), (4, "v39")]


def test_stream_errors_are_raised(spark, tmp_path):
    drop_file(tmp_path, 1, RAW_ROWS[1])
    house = Lakehouse(spark, str(tmp_path))
    with pytest.raises(Exception, match="no_such_column"):
        house.bronze_cdc("s", "thing", "id", "no_such_column")


def test_one_failing_stream_does_not_stop_the_others(spark, tmp_path):
    drop_file(tmp_path, 1, RAW_ROWS[1])
    entry = {"schema": "s", "tablename_load": "thing", "id_field": "id"}
    entries = [
        {**entry, "tablename_save": "broken", "timestamp_field": "no_such_column"},
        {**entry, "tablename_save": "thing", "timestamp_field": "updated_at"},
    ]
    house = Lakehouse(spark, str(tmp_path))
    with pytest.raises(Exception, match="no_such_column"):
        house.run_bronze(config.parse(config.BronzeEntry, entries))
    assert state(house) == [(1, "a")]
    assert not house.table("bronze", "s", "broken").exists()


def test_given_columns_need_no_inference(spark, tmp_path):
    drop_file(tmp_path, 1, RAW_ROWS[1])
    entry = {"schema": "s", "tablename_load": "thing", "id_field": "id", "timestamp_field": "at",
             "columns": "id int, updated_at string, name string, at timestamp"}
    house = Lakehouse(spark, str(tmp_path))
    entries = [{**entry, "tablename_save": "thing"}, {**entry, "tablename_save": "all", "full_load": True}]
    house.run_bronze(config.parse(config.BronzeEntry, entries))
    for name in ("thing", "all"):
        df = house.load("bronze", "s", name)
        assert df.schema.simpleString() == "struct<id:int,updated_at:string,name:string,at:timestamp>"
        assert df.count() == 1


def test_extra_columns_are_ignored_later(spark, tmp_path):
    house = Lakehouse(spark, str(tmp_path))
    drop_file(tmp_path, 1, RAW_ROWS[1])
    house.bronze_cdc("s", "thing", "id", "updated_at")
    drop_file(tmp_path, 2, [{**row, "more": 1} for row in RAW_ROWS[2]])
    house.bronze_cdc("s", "thing", "id", "updated_at")
    assert house.load("bronze", "s", "thing").columns == ["id", "name", "updated_at", "urls"]
    assert state(house) == [(1, "b"), (2, "c")]


SQL = {
    "thing": "SELECT id AS idThing, name AS nameThing, updated_at AS changedAt FROM s_thing",
    "thing_url": r"""
        WITH urls AS (SELECT id, EXPLODE(urls) AS url FROM s_thing)
        SELECT id AS idThing, REGEXP_EXTRACT(url, r'/(\d+)$') AS idUrl FROM urls
    """,
    "urls_by_thing": """
        SELECT idThing, COUNT(idUrl) AS n, CURRENT_TIMESTAMP() AS loadedAt
        FROM s_thing_url GROUP BY idThing
    """,
}


def test_workflows(spark, tmp_path):
    for number in (1, 2):
        drop_file(tmp_path, number, RAW_ROWS[number])
    sql_dir = tmp_path / "sql"
    sql_dir.mkdir()
    for name, text in SQL.items():
        (sql_dir / f"{name}.sql").write_text(text)
    flows = {
        "bronze": [{"full_load": False, "tablename_load": "thing", "tablename_save": "thing",
                    "schema": "s", "id_field": "id", "timestamp_field": "updated_at"}],
        "silver": [
            {"schema": "s", "tablename_load": "thing", "tablename_save": "thing",
             "merge_condition": "t.idThing = s.idThing "},
            {"schema": "s", "tablename_load": "thing", "tablename_save": "thing_url",
             "merge_condition": False},
        ],
        "gold": [{"tablename_load": "thing_url", "tablename_save": "urls_by_thing", "schema": "s",
                  "date_field": "loadedAt", "new_table": False, "date": "2024-10-04"}],
    }
    for layer, entries in flows.items():
        (tmp_path / f"{layer}.json").write_text(json.dumps(entries))
    house = Lakehouse(spark, str(tmp_path))

    def run():
        house.run_bronze(config.load(spark, f"{tmp_path}/bronze.json", config.BronzeEntry))
        house.run_silver(config.load(spark, f"{tmp_path}/silver.json", config.SilverEntry), str(sql_dir))
        house.run_gold(config.load(spark, f"{tmp_path}/gold.json", config.GoldEntry), str(sql_dir))

    def table(layer, name, *columns):
        df = house.load(layer, "s", name).select(*columns)
        return sorted(map(tuple, df.collect()), key=repr)

    run()
    assert table("silver", "thing", "idThing", "nameThing") == [(1, "b"), (2, "c")]
    assert table("silver", "thing_url", "idThing", "idUrl") == [(2, "7")]
    assert table("gold", "urls_by_thing", "idThing", "n") == [(2, 1)]
    drop_file(tmp_path, 3, RAW_ROWS[3][:2])
    drop_file(tmp_path, 4, RAW_ROWS[1])
    run()
    run()
    assert table("silver", "thing", "idThing", "nameThing") == [(1, "a"), (2, "e")]
    assert table("gold", "urls_by_thing", "idThing", "n") == [(1, 2), (2, 1)]
    assert house.delete_day("s", "urls_by_thing", "snapshot_date", "2024-10-04") == 2
    assert table("gold", "urls_by_thing", "idThing") == []


def test_silver_reads_only_changed_buckets(spark, tmp_path):
    house, sql = Lakehouse(spark, str(tmp_path)), tmp_path / "thing.sql"
    sql.write_text(SQL["thing"])
    columns = "id long, name string, updated_at string"
    bronze, silver = house.table("bronze", "s", "thing"), house.table("silver", "s", "thing")

    def run(*rows):
        house.upsert(spark.createDataFrame(rows, columns), "s", "thing", "id", "updated_at", buckets=8)
        house.to_silver(str(sql), "s", "thing", "t.idThing = s.idThing", incremental=True)

    run((1, "a", "5"), (2, "b", "2"), *[(i, "x", "1") for i in range(10, 30)])
    before = bronze.meta()["version"]
    run((1, "late", "3"))  # last batch wins with an older stamp
    assert len(bronze.changed_since(before)) == 1
    got = {r.idThing: r.nameThing for r in house.load("silver", "s", "thing").collect()}
    assert (got[1], got[2], len(got)) == ("late", "b", 22)
    version = silver.meta()["version"]
    house.to_silver(str(sql), "s", "thing", "t.idThing = s.idThing", incremental=True)
    assert silver.meta()["version"] == version


def test_malformed_records(spark, tmp_path):
    house, folder = Lakehouse(spark, str(tmp_path)), tmp_path / "raw" / "s" / "thing"
    folder.mkdir(parents=True)
    good = {"id": 1, "name": "a", "updated_at": "1"}
    (folder / "2024-10-04_001.json").write_text(f"bad one\n{json.dumps(good)}\n5\n")
    house.bronze_cdc("s", "thing", "id", "updated_at")
    (folder / "plain").write_text(json.dumps({**good, "id": 2}) + "\n{cut")
    house.bronze_cdc("s", "thing", "id", "updated_at")
    assert state(house) == [(1, "a"), (2, "a")]
    assert house.load("bronze", "s", "thing").columns == ["id", "name", "updated_at"]
    bad = house.rejects("s", "thing").read().collect()
    assert sorted((r.record, r.batch) for r in bad) == [("5", 0), ("bad one", 0), ("{cut", 1)]
    assert {r.file.rsplit("/", 1)[1] for r in bad} == {"2024-10-04_001.json", "plain"}
    with pytest.raises(ValueError, match="plain"):
        house.bronze_full_load("s", "thing", "again")
    (folder / "plain").unlink()
    house.bronze_full_load("s", "thing", "again")
    assert house.load("bronze", "s", "again").count() == 1
    assert house.rejects("s", "again").read().count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        house.bronze_cdc("s", "thing", "id", "updated_at", save="strict", fail_fast=True)


@pytest.mark.parametrize("files", [1, None])
def test_files_of_any_name_arrive_in_order(spark, tmp_path, files):
    import gzip

    house, folder = Lakehouse(spark, str(tmp_path)), tmp_path / "raw" / "s" / "thing"
    drop_file(tmp_path, 1, [{"id": 1, "name": "plain", "updated_at": "9"}, {"id": 2, "name": "p", "updated_at": "9"}])
    (folder / "b.json.gz").write_bytes(gzip.compress(b'{"id": 3, "name": "packed", "updated_at": "1"}'))
    (folder / "c").write_text('{"id": 4, "name": "bare", "updated_at": "1"}')
    row = spark.createDataFrame([(1, "landed", "1")], "id long, name string, at string")
    house.land(row, "s", "thing", "2024-10-04T10:00:00", stamp_field="updated_at")
    columns = "id long, name string, updated_at string"
    house.bronze_cdc("s", "thing", "id", "updated_at", columns=columns, max_files_per_trigger=files)
    assert state(house) == [(1, "landed"), (2, "p"), (3, "packed"), (4, "bare")]


def test_early_errors_do_not_leave_streams(spark, tmp_path):
    drop_file(tmp_path, 1, RAW_ROWS[1])
    entry = {"schema": "s", "id_field": "id", "timestamp_field": "updated_at"}
    entries = [
        {**entry, "tablename_load": "thing", "tablename_save": "thing"},
        {**entry, "tablename_load": "missing", "tablename_save": "missing"},
        {**entry, "tablename_load": "thing", "tablename_save": "all", "full_load": True, "dedupe": True},
    ]
    house = Lakehouse(spark, str(tmp_path))
    with pytest.raises(Exception, match="(?i)path"):
        house.run_bronze(config.parse(config.BronzeEntry, entries))
    assert state(house) == [(1, "a")] and not spark.streams.active
    assert house.load("bronze", "s", "all").count() == 1


def test_gold_stamp_and_date_agree(spark, tmp_path):
    house, sql = Lakehouse(spark, str(tmp_path)), tmp_path / "g.sql"
    sql.write_text("SELECT count(*) AS n, CURRENT_TIMESTAMP() AS at FROM s_thing")
    house.save(spark.range(3), "silver", "s", "thing")
    options = {"date_field": "at", "as_of": "2024-10-04T10:00:00"}
    house.to_gold(str(sql), "s", "thing", "2024-10-04", **options)
    row = house.load("gold", "s", "g").first()
    assert (row.n, str(row["at"]), str(row.snapshot_date)) == (3, "2024-10-04 10:00:00", "2024-10-04")
    with pytest.raises(ValueError):
        house.to_gold(str(sql), "s", "thing", "2024-10-05", **options)


@contextmanager
def kept_settings(spark):
    """The command line asks for its own session settings, and gets this session."""
    before = {key: spark.conf.get(key, None) for key in DEFAULTS}
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_command_line(spark, tmp_path):
    from lakestrata.__main__ import main

    drop_file(tmp_path, 1, RAW_ROWS[1])
    (tmp_path / "thing.sql").write_text(SQL["thing"])
    entry = {"schema": "s", "tablename_load": "thing", "tablename_save": "thing"}
    flows = {
        "bronze": {**entry, "full_load": True, "id_field": "id", "timestamp_field": "updated_at"},
        "silver": {**entry, "merge_condition": "t.idThing = s.idThing"},
    }
    for layer, flow in flows.items():
        path = tmp_path / f"{layer}.json"
        path.write_text(json.dumps([flow]))
        with kept_settings(spark):
            main([layer, str(path), "--root", str(tmp_path)])
    got = Lakehouse(spark, str(tmp_path)).load("silver", "s", "thing")
    assert [tuple(r) for r in got.collect()] == [(1, "a", "2024-10-04T10")]


def test_configs():
    parsed = config.parse(config.GoldEntry, _WORKFLOW["gold"])
    assert [e.tablename_save for e in parsed] == ["orders_by_year", "orders_by_customer"]
    with pytest.raises(ValueError, match="unknown keys"):
        config.parse(config.SilverEntry, [{"schema": "s", "colour": "red"}])


def test_layout():
    assert Layout("/lake/").path("bronze", "s", "t") == "/lake/bronze/s/t"
    buckets = Layout(pattern="s3a://{layer}/{schema}/{table}")
    assert buckets.path("gold", "s", "t") == "s3a://gold/s/t"
    assert buckets.checkpoint("s", "t") == "s3a://checkpoints/s/t_checkpoint"
