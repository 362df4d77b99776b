"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir); all but the last return the columns of documents.

Rows with null ids or texts go through every stage; no stage but the last reads a table that it could do without.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakestrata.functions.columns import row_identity
from lakestrata.llm import bpe, decontam, minhash, substring, toxicity
from lakestrata.llm.frames import column, fresh, inputs

BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labelled ones among them, does not reject."""
    chain = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, chain, carry=True).filter("NOT toxic").select("rest.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least id; texts without words all stay.

    Of rows that share id and words, in whatever spelling, that with the least hash of the whole row stays, so the same one
    however the table is partitioned; null ids come last.
    """
    found = minhash.classes(docs)
    groups = found.filter("node IS NOT NULL").select(F.col("doc_id").alias("id"), "node", "root")
    # null ids come last; a node has one root, so a keeper's node stands for its group
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node"))
    keeper = groups.groupBy("root").agg(least.alias("k")).select(F.col("k.id").alias("of"), F.col("k.node").alias("kept"))
    node = fresh(docs, "node")
    rows = minhash.with_nodes(docs, node=node)
    own = rows.join(keeper, (F.col(node) == F.col("kept")) & column(rows, "doc_id").eqNullSafe(F.col("of")))
    # of rows of one id and node, one stays; the join has put them together
    turn = fresh(own, "turn")
    told = row_identity(docs.schema, ["one", "two"]).values()
    first = own.withColumn(turn, F.row_number().over(Window.partitionBy(node, "doc_id").orderBy(*told)))
    first = first.filter(F.col(turn) == 1).select(*[column(first, c) for c in docs.columns])
    wordless = rows.filter(F.col(node).isNull()).select(*[column(rows, c) for c in docs.columns])
    return first.unionByName(wordless)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that an earlier document has; others keep their text as it is."""
    found = substring.remove_repeats(docs, carry=True)
    changed = F.col("n_removed") > 0
    out = []
    for c in docs.columns:
        old = F.col("rest")[c]
        new = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema[c].dataType)}.get(c)
        out.append((old if new is None else F.when(changed, new).otherwise(old)).alias(c))
    return found.select(*out)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark passages."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.find(docs, benchmark, carry=True).filter("NOT contaminated").select("rest.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document's text, and digests of the ids and of what they decode to."""
    return bpe.round_trip(inputs(docs, doc_id="doc_id", text="text"), BPE_RANKS, public_tokenizers.PATTERN)
