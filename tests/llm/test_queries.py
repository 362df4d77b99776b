"""The registered queries of the subpackage that have an SQL twin."""

import oracle
import pytest

from lakestrata.llm import queries

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, duck, name):
    columns, rows = oracle.spark_rows(queries.queries()[name](spark, SF_DIR))
    want_columns, want = oracle.duck_rows(duck, queries.oracle_sql()[name])
    assert columns == want_columns
    assert rows == want
    assert rows
