"""Silver tables of grouping SQL, kept up to date by the groups that changed."""

import random

import pytest

from lakestrata.operators import affected
from lakestrata.operators.upsert import upsert
from lakestrata.plans.lakehouse import Lakehouse
from lakestrata.sources import fs

KIND = "k long, ts long, grp string, x long"
SQL = "SELECT grp AS g, substr(grp, 1, 1) AS h, COUNT(DISTINCT x) AS n, MAX(x) AS top FROM shop_thing GROUP BY grp"
GROUPS = {"g": "grp"}


@pytest.fixture
def house(spark, folder):
    fs.write_text(spark, f"{folder}/sql/thing.sql", SQL)
    return Lakehouse(spark, folder)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def put(spark, house, data):
    upsert(house.table("bronze", "shop", "thing"), spark.createDataFrame(data, KIND), "k", "ts", buckets=16)


def refresh(house):
    house.to_silver_groups(f"{house.layout.root}/sql/thing.sql", "shop", "thing", GROUPS, buckets=8)
    return house.load("silver", "shop", "thing")


def full(spark, house):
    house.load("bronze", "shop", "thing").createOrReplaceTempView("whole")
    return spark.sql(SQL.replace("shop_thing", "whole"))


@pytest.mark.parametrize("seed", range(2))
def test_equals_the_whole_transform(spark, house, seed):
    """Inserts, updates that move rows between groups, groups that vanish or have no key, and runs without a change."""
    rnd = random.Random(seed)
    names = [None, *(f"g{i}" for i in range(12))]
    put(spark, house, [(i, 0, rnd.choice(names), rnd.randrange(9)) for i in range(80)])
    for step in range(1, 4):
        assert rows(refresh(house)) == rows(full(spark, house))
        change = [(rnd.randrange(100), step, rnd.choice(names if step > 1 else names[1:4]), rnd.randrange(9)) for _ in range(10)]
        put(spark, house, list({r[0]: r for r in change}.values()))
    table = house.table("bronze", "shop", "thing")
    gone = table.read().filter("grp <=> 'g5' OR grp <=> 'g6'")
    table.replace(table.read().exceptAll(gone), list(table.meta()["live"]))
    assert rows(refresh(house)) == rows(full(spark, house))
    assert refresh(house).filter("g IN ('g5', 'g6')").isEmpty()


def test_only_affected_groups_and_buckets_are_worked_on(spark, house, monkeypatch):
    put(spark, house, [(i, 0, f"g{i % 40}", i) for i in range(400)])
    refresh(house)
    silver, bronze = house.table("silver", "shop", "thing"), house.table("bronze", "shop", "thing")
    before, version = silver.meta()["live"], bronze.meta()
    put(spark, house, [(7, 1, "g7", 1000), (8, 1, "g8", 8)])
    assert len(affected.changed_partitions(version, bronze.meta())) <= 2
    found, seen = affected.rows_of_groups, []

    def watched(*args):
        seen.append(found(*args))
        return seen[-1]

    monkeypatch.setattr(affected, "rows_of_groups", watched)
    assert rows(refresh(house)) == rows(full(spark, house))
    assert sorted({r.grp for r in seen[0].collect()}) == ["g7", "g8"] and seen[0].count() == 20
    after = silver.meta()["live"]
    assert 1 <= sum(before.get(p) != after.get(p) for p in after) <= 2


def test_rewritten_rows_cancel_out(spark, house):
    """A bucket that was rewritten with the same rows affects no group, and silver keeps its files."""
    put(spark, house, [(i, 0, f"g{i % 5}", i) for i in range(50)])
    refresh(house)
    table, silver = house.table("bronze", "shop", "thing"), house.table("silver", "shop", "thing")
    live = silver.meta()["live"]
    table.replace(table.read(), list(table.meta()["live"]))
    assert rows(refresh(house)) == rows(full(spark, house))
    assert silver.meta()["live"] == live
    version = silver.meta()["version"]
    refresh(house)
    assert silver.meta()["version"] == version


def test_a_purged_version_or_new_column_means_a_whole_run(spark, house):
    put(spark, house, [(i, 0, f"g{i % 5}", i) for i in range(50)])
    refresh(house)
    table = house.table("bronze", "shop", "thing")
    for step in (1, 2):
        put(spark, house, [(i, step, "g1", 7 * step) for i in range(20)])
    table.purge(1)
    assert rows(refresh(house)) == rows(full(spark, house))
    table.evolve(spark.createDataFrame([], "extra string").schema)
    assert rows(refresh(house)) == rows(full(spark, house))
