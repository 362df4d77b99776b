"""A cleaning pipeline over the documents table; every stage is written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakestrata.llm import stages
from lakestrata.llm.frames import stored

STAGES = [
    ("toxicity", stages.without_toxic),
    ("near_dedup", stages.one_of_each_group),
    ("substring_dedup", stages.without_repeats),
    ("decontamination", stages.without_benchmark),
    ("byte_bpe", stages.encoded),
]

#: Tokenisation, learning and connected groups have no SQL form; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
