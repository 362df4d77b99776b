"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestrata.llm import (
    bpe,
    decontam,
    langid,
    middle,
    minhash,
    neighbours,
    quotes,
    resample,
    simhash,
    substring,
    suffixes,
    toxicity,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _query(name: str, sql: str | None = None):
    def add(run: Query) -> Query:
        _QUERIES[name] = run
        if sql is not None:
            _ORACLES[name] = sql
        return run

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@_query("op10_byte_bpe")
def _byte_bpe(spark, sf_dir):
    return bpe.round_trip(_read(spark, sf_dir, "documents"), BPE_RANKS, public_tokenizers.PATTERN)


_SUBSTRING_SQL = r"""
WITH docs AS (
    SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS p FROM docs, unnest(range(1, len(w) - 18)) AS u(i)
), later AS (
    SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY p ORDER BY doc_id, i) > 1
), gone AS (
    SELECT DISTINCT doc_id, j FROM later, unnest(range(i, i + 20)) AS u(j)
), kept AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS words
    FROM (SELECT doc_id, j, w[j] AS word FROM docs, unnest(range(1, len(w) + 1)) AS u(j)) ANTI JOIN gone USING (doc_id, j)
    GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""


@_query("op1_substring_dedup", _SUBSTRING_SQL)
def _substring_dedup(spark, sf_dir):
    found = substring.remove_repeats(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_query("op7_suffix_array_dedup")
def _suffix_array_dedup(spark, sf_dir):
    found = suffixes.remove_repeats(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


_DECONTAM_SQL = r"""
WITH lowered AS (
    SELECT 'd' AS kind, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents
    UNION ALL
    SELECT 'b', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), words AS (
    SELECT kind, id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM lowered
), patterns AS (
    SELECT DISTINCT id AS item, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS p
    FROM words, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(i)
    WHERE kind = 'b' AND len(w) > 0
), windows AS (
    SELECT id, size, i, array_to_string(w[i:i + size - 1], ' ') AS p
    FROM words, (SELECT DISTINCT size FROM patterns) AS s, unnest(range(1, len(w) - size + 2)) AS u(i)
    WHERE kind = 'd'
), found AS (
    SELECT id, i, size, item FROM windows JOIN patterns USING (size, p)
), hit AS (
    SELECT id, count(DISTINCT j) AS n_hit FROM found, unnest(range(i, i + size)) AS u(j) GROUP BY id
), items AS (
    SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT id, item::VARCHAR AS item FROM found) GROUP BY id
)
SELECT id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (id) LEFT JOIN items USING (id)
WHERE kind = 'd'
"""


@_query("op2_decontamination", _DECONTAM_SQL)
def _decontamination(spark, sf_dir):
    found = decontam.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    names = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", names, "contaminated")


_WARC_SQL = """
WITH pages_ AS (
    SELECT page_id, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS size FROM pages
), largest AS (
    SELECT digest, max(page_id) AS original FROM pages_ WHERE size >= 1000 GROUP BY digest
)
SELECT page_id, size AS payload_bytes, digest AS payload_digest,
    CASE WHEN page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < original THEN original END AS refers_to
FROM pages_ LEFT JOIN largest USING (digest)
"""


@_query("op9_warc", _WARC_SQL)
def _warc(spark, sf_dir):
    found = warc.round_trip(_read(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query("op5_probminhash")
def _probminhash(spark, sf_dir):
    return minhash.classes(_read(spark, sf_dir, "documents")).select("doc_id", "class_id")


@_query("op6_toxicity")
def _toxicity(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


@_query("op8_learned_partitions")
def _learned_partitions(spark, sf_dir):
    vectors = _read(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


# The table holds no quotations, which SQL can follow: each message then answers the one before it.
_QUOTES_SQL = r"""
SELECT conv_id, turn, role, position, nullif(position - 1, 0) AS reply_to, position - 1 AS depth,
    0 AS n_quotes, 0 AS n_linked, sha256(text) AS text_sha256
FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, sha256(text)) AS position FROM conversations
) WHERE NOT regexp_matches(text, '(^|\n)[ \t]*>')
"""


@_query("op4_quotation_linking", _QUOTES_SQL)
def _quotation_linking(spark, sf_dir):
    messages, _ = quotes.link(_read(spark, sf_dir, "conversations"))
    return messages.withColumn("text_sha256", F.sha2("text", 256)).drop("text", "rank")


# Without quotations a conversation is a chain, whose reply order is that of its positions.
_REPLY_ORDER_SQL = r"""
SELECT conv_id, position, position AS rank, position - 1 AS depth, sha256(text) AS text_sha256
FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, sha256(text)) AS position FROM conversations
) WHERE NOT regexp_matches(text, '(^|\n)[ \t]*>')
"""


@_query("op4_reply_order", _REPLY_ORDER_SQL)
def _reply_order(spark, sf_dir):
    messages, _ = quotes.link(_read(spark, sf_dir, "conversations"))
    return messages.select("conv_id", "position", "rank", "depth", F.sha2("text", 256).alias("text_sha256"))


@_query("op3_language_id")
def _language_id(spark, sf_dir):
    return langid.identify(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "documents"))


_MIDDLE_SQL = r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\n]*\n|[^\n]+'), []) AS u,
        sha256('7:' || doc_id) AS h
    FROM documents
), numbers AS (
    SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
        t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain, ('0x' || h[25:32])::BIGINT % 100 < 50 AS spm
    FROM units
), parts AS (
    SELECT doc_id, t, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
        array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
        array_to_string(u[greatest(a, b) + 1:], '') AS s
    FROM numbers
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
        ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts
"""


@_query("op11_fill_in_middle", _MIDDLE_SQL)
def _fill_in_middle(spark, sf_dir):
    found = middle.transform(_read(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(middle.restored(), 256).alias("restored_sha256")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


# CRC-32 by its table of 256 remainders, which follows from the polynomial.
_RESAMPLE_SQL = r"""
WITH remainders AS (
    SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS r
    FROM range(256) AS t(i)
), lowered AS (
    SELECT 'd' AS kind, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents
    UNION ALL
    SELECT 'b', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), words AS (
    SELECT kind, id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM lowered
), bytes AS (
    SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM words)
), sums AS (
    SELECT w, xor(list_reduce([4294967295] || list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT),
        lambda c, b: xor(r[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
    FROM bytes, remainders
), held AS (
    SELECT kind, id, bucket, count(*) AS n FROM words JOIN sums USING (w) GROUP BY ALL
), totals AS (
    SELECT sum(n) FILTER (kind = 'd')::DOUBLE AS s_all, coalesce(sum(n) FILTER (kind = 'b'), 0)::DOUBLE AS t_all FROM held
), counts AS (
    SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 'b'), 0)::DOUBLE AS t
    FROM held GROUP BY bucket
), gains AS (
    SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM counts, totals
), weights AS (
    SELECT id AS doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM held JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY 1
), scored AS (
    SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM documents LEFT JOIN weights USING (doc_id)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
        count(*) FILTER (n_features >= 20) OVER () AS n
    FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM ranked
"""


@_query("op12_importance_resampling", _RESAMPLE_SQL)
def _importance_resampling(spark, sf_dir):
    found = resample.importance(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@_query("op13_simhash")
def _simhash(spark, sf_dir):
    return simhash.classes(_read(spark, sf_dir, "documents"))
