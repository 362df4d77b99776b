"""The classifier chain on labelled documents held out from training, and on odd rows."""

import re

import numpy as np
import pytest

import __spark_entry__ as contract
from lakestrata.llm import toxicity


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit(docs, labels.filter("doc_id % 2 = 0"))
    held = toxicity.score(docs, chain).join(labels.filter("doc_id % 2 = 1").withColumnRenamed("toxic", "label"), "doc_id").collect()
    right = [r.toxic == bool(r.label) for r in held]
    assert np.mean(right) > 0.95
    clean = [r for r in held if not r.label]
    assert sum(r.toxic for r in clean) <= 0.005 * len(clean)
    assert chain.names == ["insult", "contempt", "disgust", "toxic"]


def test_chain_uses_earlier_categories():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 2, (2000, 6)).astype(float)
    first = x[:, 0] * x[:, 1]
    second = (first + x[:, 2] > 1).astype(float)
    chain = toxicity.fit_chain(x, {"a": first, "toxic": second}, np.arange(6, dtype=np.uint64))
    assert len(chain.weights[1]) == 6 + 1 + 1 and chain.weights[1][6] > 0
    said = chain.predict(x)
    assert ((said[:, 1] >= chain.threshold) == (second > 0)).mean() > 0.95


def test_threshold():
    assert toxicity.best_threshold(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1.0, 1, 0, 0])) == 0.55
    assert toxicity.best_threshold(np.array([0.5, 0.5, 0.5]), np.array([1.0, 0, 1])) == 0.25


def test_odd_rows(spark):
    rows = [(i, ("you idiot " if i % 2 else "the day ") + f"word{i % 5} and {i} more", 0) for i in range(300)]
    rows += [(400, None, 1), (401, "", 1), (None, "you idiot", 1), (402, "new " * 50_000 + "IDIOT!", 1), (7, "you idiot word", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(9999, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    chain = toxicity.fit(docs, labels)
    got = toxicity.score(docs, chain).collect()
    assert len(got) == len(rows)
    assert {r.doc_id for r in got if r.toxic} == {i for i in range(300) if i % 2} | {None, 402}
    for part in (labels.limit(0), labels.filter("toxic = 0")):
        none = toxicity.fit(docs, part)
        assert none is None and not any(r.toxic for r in toxicity.score(docs, none).collect())
    assert toxicity.score(docs.limit(0), chain).collect() == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    got = contract.queries()["op6_toxicity"](spark, sf).collect()
    assert len(got) == 1000 and 0.02 < np.mean([r.toxic for r in got]) < 0.2


def test_odd_rows_of_few_texts(spark):
    rows = [(i, ("you idiot " if i % 2 else "the day ") + f"word{i % 5} and", 0) for i in range(200)]
    rows += [(300, None, 1), (301, "", 1), (None, "you idiot", 1), (302, "new " * 50_000 + "IDIOT!", 1), (7, "you idiot word", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)] + [(9999, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert {r.doc_id for r in got if r.toxic} == {i for i in range(200) if i % 2} | {None, 302}


@pytest.mark.parametrize(("clean", "toxic"), [(50, 50), (30, 30), (70, 10), (20, 60)])
def test_planted_on_small_label_sets(spark, clean, toxic):
    rnd = np.random.default_rng(clean)
    prose = lambda: " ".join(f"w{x}" for x in rnd.integers(0, 3000, 60))
    said = lambda i: prose() + (" you utter scum" if i >= 1000 else "")
    labelled = [*range(clean), *range(1000, 1000 + toxic)]
    ids = [*labelled, *range(500, 540), *range(1500, 1540)]
    docs = spark.createDataFrame([(i, said(i)) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 1000)) for i in labelled], "doc_id long, toxic int")
    got = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).filter("toxic").collect()}
    assert got == {i for i in ids if i >= 1000}


def test_smallest_table_rejects(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    abuse = set("disgusting scum moron loser trash worthless clown pathetic stupid idiot".split())
    label = {r.doc_id: r.toxic for r in labels.collect()}
    holds = {r.doc_id for r in docs.collect() if label.get(r.doc_id) and abuse.intersection(re.findall(r"\w+", r.text.lower()))}
    got = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).filter("toxic").collect()}
    assert len(holds) == 7 and holds <= got and not any(label.get(i) == 0 for i in got)
