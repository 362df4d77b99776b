"""The pipeline's stages on documents with planted cases, and their composition over a whole table."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from test_decontam import brute as brute_hits
from test_minhash import bag, groups, jp
from test_substring import brute as brute_repeats

import corpus_pipeline
from lakestrata.llm import bpe, stages, toxicity

SF = "/root/testdata/sf0.001"


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rnd = random.Random(9)
    folder = str(tmp_path_factory.mktemp("planted"))
    clean = [prose(rnd, 150) for _ in range(60)]
    passage, item = prose(rnd, 60), prose(rnd, 30)
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100 + i, prose(rnd, 40) + " you idiot scum") for i in range(60)]
    rows += [(200, clean[3]), (201, clean[3].upper()), (202, clean[4] + " one more"), (3, clean[3])]
    rows += [(210, f"{prose(rnd, 60)} {passage}"), (211, f"{passage} {prose(rnd, 60)}")]
    rows += [(220, f"{prose(rnd, 50)} {item}"), (230, None), (231, ""), (None, prose(rnd, 50))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], schema)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(100 <= i < 160)) for i in [*range(60), *range(100, 150)]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(rnd, 20))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict(rows), passage


def test_planted(spark, planted):
    folder, texts, passage = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, folder)
        assert docs.schema.names == before.schema.names, name
    got = {r.doc_id: r for r in docs.collect()}
    assert docs.count() == len(got)
    assert got.keys() == {*range(60), 210, 211, 230, 231, None}
    assert all(got[i].text == texts[i] for i in got if i != 211)
    assert got[211].text == " ".join(texts[211].split()[60:]) and got[211].n_chars == len(got[211].text)
    final = corpus_pipeline.run(spark, folder).collect()
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(stages.BPE_RANKS), special_tokens={})
    want = {i: other.encode_ordinary(r.text or "") for i, r in got.items()}
    assert {r.doc_id: r.n_tokens for r in final} == {i: len(x) for i, x in want.items()}
    assert {r.doc_id: r.ids_sha256 for r in final} == {i: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for i, x in want.items()}


def test_one_of_each_group_whatever_the_ids(spark):
    rnd = random.Random(10)
    a, b, c, d = (prose(rnd, 120) for _ in range(4))
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (6, c), (7, d + " x"), (8, "x " + d), (None, d + " y"), (None, None), (5, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], schema)
    got = stages.one_of_each_group(spark, docs, "").collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, [(None, a), (None, b), (5, c), (5, d), (None, None), (5, "")]))


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    chain = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(docs, chain).filter("toxic").collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in toxic}
    bags = {d: bag(t) for d, t in rows.items()}
    ids = sorted(rows)
    near = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if bags[a].keys() & bags[b].keys() and jp(bags[a], bags[b]) >= 0.8]
    root = groups(near, bags)
    rows = {d: t for d, t in rows.items() if root[d] == d}
    rows = {d: kept if gone else rows[d] for d, _, gone, kept in brute_repeats(list(rows.items()))}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = {r[0]: rows[r[0]] for r in brute_hits(list(rows.items()), items, 13) if not r[5]}
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in rows.items()}


def test_empty(spark, planted, tmp_path):
    folder, _, _ = planted
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_the_same_row_stays_however_the_table_is_partitioned(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(7, t, "en", s, 1) for t in (words, words.upper(), words.replace(" ", "  "), words.replace(" ", ", ")) for s in ("a", "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = set()
    for parts in range(1, 7):
        found = stages.one_of_each_group(spark, docs.repartition(parts, "text", "source"), "").collect()
        assert len(found) == 1
        kept.add(tuple(found[0]))
    assert len(kept) == 1


def test_many_rows_without_an_id_or_with_one_id(spark):
    """Rows that share an id do not meet each other: work grows with the rows, and every group is found."""
    rows = [(i % 2 or None, " ".join(f"w{(i // 4) * 31 + j}" for j in range(30)), "en", "a", 1) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(8)
    kept = stages.one_of_each_group(spark, docs, "").collect()
    assert len(kept) == 500 and {r.doc_id for r in kept} == {1}
