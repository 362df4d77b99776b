"""Landing queries on tables whose statuses and event types are not those of the test tables."""

import duckdb
import oracle
import pytest
from pyspark.sql import functions as F

from lakestrata.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = [
    "landing_numbered_batches",
    "cdc_stream_available_now",
    "cdc_stream_last_batch_wins",
    "cdc_stream_one_file_per_trigger",
    "cdc_stream_rerun",
    "stream_inferred_schema",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("values"))
    for table, key, column in (("events", "event_id", "event_type"), ("orders", "o_orderkey", "o_orderstatus")):
        rows = spark.read.parquet(f"{SF}/{table}.parquet")
        new = F.when(F.col(key) % 7 == 0, "Z").when(F.col(key) % 11 == 0, "A").when(F.col(key) % 13 != 0, F.col(column))
        rows.withColumn(column, new).write.parquet(f"{folder}/{table}.parquet")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_every_value_lands(spark, folder, name):
    duck = duckdb.connect()
    for table in ("events", "orders"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = oracle.spark_rows(catalog.queries()[name](spark, folder))
    assert got == oracle.duck_rows(duck, catalog.oracle_sql()[name])
