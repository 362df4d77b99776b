"""Projections, functions, raw files and landing on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from lakestrata.functions.columns import iso_day, parse_day, trailing_id, year_of
from lakestrata.operators.shape import count_by, duplicate_keys, explode_bridge, id_range
from lakestrata.plans.sql import LATEST_SQL, run_sql, share_view
from lakestrata.session import scratch_dir
from lakestrata.sources import fs
from lakestrata.sources.files import (
    infer_schema,
    read_files,
    read_json_checked,
    split_corrupt,
)
from lakestrata.sources.landing import batch_number, land_batch, next_batch_number


def values(df):
    return [row[0] for row in df.collect()]


def test_trailing_id(spark):
    urls = ["https://h/api/x/12", "https://h/api/x/", "", None, "https://h/12?p=1"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert values(df.select(trailing_id("u"))) == ["12", "", "", None, ""]
    assert values(df.select(trailing_id("u", empty_as_null=True))) == ["12", None, None, None, None]
    assert values(df.select(trailing_id("u", cast_to="bigint"))) == [12, None, None, None, None]


def test_days_in_words(spark):
    days = ["December 2, 2013", "December 02, 2013", "Dec 2, 2013", "bad", None]
    df = spark.createDataFrame([(d,) for d in days], "d string")
    assert values(df.select(year_of("d", tolerant=True))) == [2013, 2013, None, None, None]
    one = spark.createDataFrame([("December 2, 2013",)], "d string")
    assert str(values(one.select(parse_day("d")))[0]) == "2013-12-02"
    with pytest.raises(Exception, match="CANNOT_PARSE_TIMESTAMP"):
        df.select(parse_day("d")).collect()
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert values(df.select(year_of("d"))) == [2013, 2013, None, None, None]
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_iso_day():
    assert iso_day("2024-10-04") == "2024-10-04"
    for bad in ("2024-13-01", "", "yesterday"):
        with pytest.raises(ValueError):
            iso_day(bad)


def test_explode_bridge(spark):
    data = [(1, ["a/1", "a/x"], "s"), (2, [], "s"), (3, None, "s")]
    df = spark.createDataFrame(data, "id long, urls array<string>, at string")
    bridge = explode_bridge(df, "id", "urls", "entity", "ref", {"at": "stamp"})
    assert bridge.columns == ["entity", "ref", "stamp"]
    assert sorted(tuple(r) for r in bridge.collect()) == [(1, "", "s"), (1, "1", "s")]
    kept = explode_bridge(df, "id", "urls", "entity", "ref", outer=True, cast_to="bigint")
    assert sorted(map(str, kept.collect())) == sorted(
        f"Row(entity={e}, ref={r})" for e, r in [(1, 1), (1, None), (2, None), (3, None)]
    )
    counts = count_by(bridge, "n", F.col("ref"), entity=F.col("entity"))
    assert [tuple(r) for r in counts.collect()] == [(1, 2)]


def test_explode_bridge_reads_only_its_columns(spark, folder, capsys):
    data = [(1, ["a/1"], "s", "unused")]
    spark.createDataFrame(data, "id long, urls array<string>, at string, x string").write.parquet(
        f"{folder}/t"
    )
    df = spark.read.parquet(f"{folder}/t")
    explode_bridge(df, "id", "urls", "entity", "ref").explain()
    assert "ReadSchema: struct<id:bigint,urls:array<string>>" in capsys.readouterr().out


def test_duplicates_and_ranges(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "b"), (None, "b")], "k long, g string")
    found = sorted(map(tuple, duplicate_keys(df, ["k", "g"]).collect()), key=repr)
    assert found == [(1, "a", 2), (None, "b", 2)]
    ids = spark.range(100)
    assert id_range(ids, "id", 20, 60).count() == 41
    assert id_range(ids, "id").count() == 100
    with pytest.raises(ValueError):
        id_range(ids, "id", 20)


def test_bound_sql(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (2, 1, 1)], "k long, ts long, n long")
    got = run_sql(spark, LATEST_SQL, {"key": "k", "ts": "ts", "tie": "n"}, rows=df)
    assert sorted(map(tuple, got.collect())) == [(1, 5, 2), (2, 1, 1)]
    name = share_view(df, "bound_rows")
    assert run_sql(spark.newSession(), f"select count(*) from {name} where k = :k", {"k": 1}).first()[0] == 2


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_json_shapes(spark, tmp_path):
    write(tmp_path / "line" / "2024-10-04_001.json", json.dumps([{"id": 1}, {"id": 2}]))
    assert sorted(values(read_files(spark, f"{tmp_path}/line", "json"))) == [1, 2]
    write(tmp_path / "pretty" / "a.json", json.dumps([{"id": 1}, {"id": 2}], indent=2))
    pretty = read_files(spark, f"{tmp_path}/pretty", "json", multiLine="true")
    assert sorted(values(pretty)) == [1, 2]
    write(tmp_path / "line" / "notes.txt", "not read")
    assert read_files(spark, f"{tmp_path}/line", "json").count() == 2
    assert infer_schema(spark, f"{tmp_path}/line").simpleString() == "struct<id:bigint>"


def test_csv_header_and_types(spark, tmp_path):
    write(tmp_path / "a.csv", "id,name\n1,x\n2,y\n")
    df = read_files(spark, str(tmp_path), "csv")
    assert df.schema.simpleString() == "struct<id:int,name:string>"
    given = read_files(spark, str(tmp_path), "csv", "id bigint, name string")
    assert sorted(map(tuple, given.collect())) == [(1, "x"), (2, "y")]


def test_malformed_records(spark, tmp_path):
    lines = ['{"id": 1}', '[{"id": 2}, {"id": 3}]', "5", "not json", '"text"', '[{"id": 4}, 5]']
    write(tmp_path / "raw" / "a.json", "\n".join(lines))
    schema = spark.createDataFrame([], "id bigint").schema
    checked = read_json_checked(spark, f"{tmp_path}/raw", schema)
    good, rejected = split_corrupt(checked)
    assert sorted(values(good)) == [1, 2, 3]
    assert sorted(values(rejected)) == sorted(lines[2:])
    assert rejected.count() == 4
    with pytest.raises(Exception, match="(?i)malformed"):
        read_json_checked(spark, f"{tmp_path}/raw", schema, fail_fast=True).collect()


def test_batch_numbers(spark, folder):
    day = "2024-10-04"
    assert next_batch_number(spark, folder, day) == 1
    first = land_batch(spark.range(3), folder, day)
    assert first.endswith("/2024-10-04_001.json")
    land_batch(spark.range(2), folder, "2024-10-05")
    land_batch(spark.range(250), folder, day, array_lines=True)
    (spark.range(1).write.json(f"{folder}/2024-10-04_1000.json"))
    assert next_batch_number(spark, folder, day) == 1001
    assert next_batch_number(spark, folder, "2024-10-05") == 2
    raw = read_files(spark, folder, "json", "id bigint")
    counts = raw.groupBy(batch_number().alias("b")).count().collect()
    assert sorted((r.b, r["count"]) for r in counts) == [(1, 5), (2, 250), (1000, 1)]


def test_microseconds_survive_landing(spark, folder):
    stamp = "2024-10-04 10:00:00.123456"
    df = spark.createDataFrame([(stamp,)], "t string").select(F.col("t").cast("timestamp_ntz"))
    for array_lines in (False, True):
        land_batch(df, folder, "2024-10-04", array_lines=array_lines)
    raw = read_files(
        spark, folder, "json", df.schema, timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    )
    assert {str(v) for v in values(raw)} == {stamp}


def test_scratch_is_under_the_shared_folder(spark, folder):
    path = scratch_dir(spark)
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
    fs.write_text(spark, f"{folder}/a/b.txt", "é")
    assert fs.read_text(spark, f"{folder}/a/b.txt") == "é"
    assert fs.names(spark, f"{folder}/a") == [".b.txt.partial.crc", "b.txt"] or "b.txt" in fs.names(
        spark, f"{folder}/a"
    )
