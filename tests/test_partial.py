"""Gold from parts kept by silver bucket."""

import pytest
from pyspark.sql import functions as F

from lakestrata.operators.partial import combined, refresh_parts
from lakestrata.operators.upsert import merge_into
from lakestrata.sources.tables import Table

GROUPS = {"g": "v % 7", "big": "v > 50"}
MEASURES = {"n": ("count", "1"), "some": ("count", "w"), "total": ("sum", "w"), "low": ("min", "v"), "top": ("max", "v")}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def full(df):
    return df.groupBy((F.col("v") % 7).alias("g"), (F.col("v") > 50).alias("big")).agg(
        F.count(F.lit(1)).alias("n"), F.count("w").alias("some"), F.sum("w").alias("total"), F.min("v").alias("low"), F.max("v").alias("top")
    )


def data(spark, ids, plus):
    return spark.createDataFrame([(i, i + plus if i % 11 else None, i if i % 3 else None) for i in ids], "k long, v long, w int")


def test_parts_follow_the_changed_buckets(spark, folder):
    source, parts = Table(spark, f"{folder}/source"), Table(spark, f"{folder}/parts")
    merge_into(source, data(spark, range(200), 0), on="k", buckets=16)
    assert len(refresh_parts(parts, source, GROUPS, MEASURES)) == 16
    assert rows(combined(parts, GROUPS, MEASURES)) == rows(full(source.read()))
    before = parts.meta()["live"]
    merge_into(source, data(spark, [3, 500], 40), on="k")
    changed = refresh_parts(parts, source, GROUPS, MEASURES)
    assert 1 <= len(changed) <= 2
    assert sum(before.get(p) != v for p, v in parts.meta()["live"].items()) == len(changed)
    assert rows(combined(parts, GROUPS, MEASURES)) == rows(full(source.read()))
    assert refresh_parts(parts, source, GROUPS, MEASURES) == []
    # a bucket that loses all its rows, other definitions, other buckets
    source.drop(["_bucket=1"])
    assert refresh_parts(parts, source, GROUPS, MEASURES) == ["_bucket=1"]
    assert rows(combined(parts, GROUPS, MEASURES)) == rows(full(source.read()))
    other = {"n": ("count", "1")}
    assert len(refresh_parts(parts, source, {"g": "v % 2"}, other)) == 15
    assert combined(parts, {"g": "v % 2"}, other).agg(F.sum("n")).first()[0] == source.read().count()
    source.overwrite(source.read(), ["k"], 4)
    refresh_parts(parts, source, GROUPS, MEASURES)
    assert rows(combined(parts, GROUPS, MEASURES)) == rows(full(source.read()))


def test_plain_and_empty_tables(spark, folder):
    source, parts = Table(spark, f"{folder}/source"), Table(spark, f"{folder}/parts")
    source.overwrite(data(spark, range(30), 0))
    for _ in range(2):
        refresh_parts(parts, source, GROUPS, MEASURES)
        assert rows(combined(parts, GROUPS, MEASURES)) == rows(full(source.read()))
        source.append(data(spark, range(30, 40), 0))
    source.overwrite(source.read().filter("false"))
    refresh_parts(parts, source, GROUPS, MEASURES)
    assert combined(parts, GROUPS, MEASURES).collect() == []


def test_names_and_measures_are_checked(spark, folder):
    table = Table(spark, folder)
    for groups, measures in (({"part": "k"}, {}), ({}, {"n": ("median", "k")})):
        with pytest.raises(ValueError, match="measures"):
            refresh_parts(table, table, groups, measures)
