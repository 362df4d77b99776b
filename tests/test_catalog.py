"""Every registered query against its SQL twin on whole tables."""

import oracle
import pytest

import __spark_entry__ as contract
from lakestrata.plans import catalog

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_matches_sql(spark, duck, name):
    columns, rows = oracle.spark_rows(catalog.queries()[name](spark, SF_DIR))
    want_columns, want = oracle.duck_rows(duck, catalog.oracle_sql()[name])
    assert columns == want_columns
    assert len(rows) == len(want)
    assert rows == want
    assert rows


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns == ["order_year", "n_orders", "loaded_at", "snapshot_date"]
    assert result.count() == 7


def test_every_query_has_a_twin():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()
    assert catalog.queries().keys() <= contract.queries().keys()
