"""Language of web pages: text, declared language, address suffix and host, put together by Bayes' rule.

* Text: naive Bayes over hashed three-byte grams of the visible text. Neighbouring grams are not independent, so the
  evidence of a text counts as that of ``EFFECTIVE`` grams at most.
* Declared language (``lang`` of the html element, else a content-language meta element, attributes in any order) and
  address suffix (the last label of the host): how often each value occurs with each language, estimated over all pages from what the texts
  say, smoothed towards the value's overall share.
* Host: a prior for each host, smoothed towards its domain's (last two labels), which is smoothed towards that of all
  pages; a page's own text does not count for its own host and domain.

All counts are grouped sums of the texts' posterior probabilities. The text model is fitted on at most ``ROWS``
labelled documents, chosen by a hash of the id; everything else covers all pages. A missing text, declaration or
address gives no evidence. Ties go to the first language in alphabetical order; without labelled documents
the language is null. Repeated rows are pages of their own. Pages are read in time linear in their length, whatever
they hold; an unclosed tag, comment or script reaches to the end of its page.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestrata.llm.frames import inputs, slices, small_batches, stored

ROWS = 4000
GRAMS = 1 << 14
EFFECTIVE = 100
STRENGTH = 5.0
BATCH_BYTES = 4 << 20

HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
#: A tag ends at the next ``>`` or with the page, so that no place of a page is read for more than one tag.
TAG = re.compile(r"<([A-Za-z/!?][^\s/>]*+)([^>]*+)(?:>|\Z)")
ATTRIBUTE = re.compile(r"""([^\s=/"']++)\s*+(?:=\s*+("[^"]*+|'[^']*+|[^\s"']\S*+))?""")
LANGUAGE = re.compile(r"\s*+([A-Za-z]{2,3})\b")
HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
ZEROS = re.compile(r"&#0++(?=[0-9])")
NO_CHARACTER = re.compile(r"&#[0-9]{8,}+;?")


def unescaped(text: str) -> str:
    """Character references replaced; numbers beyond all characters, of any length, give the replacement character."""
    return entities.unescape(NO_CHARACTER.sub("�", ZEROS.sub("&#", text)))


def visible(html: str) -> str:
    return unescaped(TAG.sub(" ", HIDDEN.sub(" ", html)))


def attributes(tag: str) -> list[tuple[str, str]]:
    """Names, lower-cased, and values of a tag's attributes, in the order they stand."""
    return [(m[1].lower(), unescaped((m[2] or "").lstrip("\"'"))) for m in ATTRIBUTE.finditer(tag)]


def declared(html: str) -> str | None:
    """Language the html element names, else the first content-language meta element; comments and scripts are no tags."""
    meta = None
    for tag in TAG.finditer(HIDDEN.sub(" ", html)):
        name = tag[1].lower()
        if name == "html":
            for key, value in attributes(tag[2]):
                if key in ("lang", "xml:lang") and (found := LANGUAGE.match(value)):
                    return found[1].lower()
        elif name == "meta" and meta is None and "content-language" in tag[2].lower():
            named = attributes(tag[2])
            if any(key != "content" and value.strip().lower() == "content-language" for key, value in named):
                found = LANGUAGE.match(next((value for key, value in named if key == "content"), ""))
                meta = found and found[1].lower()
    return meta


def address(url: str | None) -> tuple[str | None, str | None, str | None]:
    """Host, domain and suffix."""
    found = HOST.match(url or "")
    if not found:
        return None, None, None
    labels = found[1].lower().strip(".").split(".")
    return ".".join(labels), ".".join(labels[-2:]), labels[-1]


def grams(text: str) -> np.ndarray:
    """Slots of the three-byte grams of a text's lower-cased words with one blank around each."""
    data = np.frombuffer(f" {' '.join(text.lower().split())} ".encode(), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.uint32)
    return (data[:-2] * 65536 + data[1:-1] * 256 + data[2:]) * np.uint32(2654435761) >> np.uint32(18)


def fit_text(docs: DataFrame, id: str, text: str, lang: str, rows: int = ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order, and the logarithm of each gram's share in each."""
    known = inputs(docs, id=id, text=text, lang=lang).filter("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    chosen = known.select("id", "lang").orderBy(F.xxhash64("id"), "id", "lang").limit(rows).select("id", F.col("lang").alias("l"))
    sample = known.join(F.broadcast(chosen.distinct()), "id")
    sample = sample.filter("lang = l").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, BATCH_BYTES):
            counts: dict[str, np.ndarray] = {}
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[name] = counts.get(name, 0) + np.bincount(grams(t), minlength=GRAMS)
            for name, n in counts.items():
                slot = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(slot), pa.string()), pa.array(slot.astype(np.int32)), pa.array(n[slot])], ["lang", "slot", "n"])

    table = sample.mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r.lang for r in table})
    counts = np.full((len(langs), GRAMS), 0.5)
    for r in table:
        counts[langs.index(r.lang), r.slot] += r.n
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True))


def _evidence(sums: DataFrame, key: str, n: int, totals: list[float], pages: float) -> DataFrame:
    """Logarithm of each value's share with each language, from sums of posteriors by value."""
    own = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    share = own / F.lit(pages)
    logs = [F.log((F.col("s")[i] + STRENGTH * share) / F.lit(totals[i] + STRENGTH)) for i in range(n)]
    return sums.select(F.col(key).alias(f"{key}_"), F.array(*logs).alias(f"e_{key}"))


def identify(
    pages: DataFrame, docs: DataFrame, id: str = "page_id", url: str = "url", html: str = "html",
    doc_id: str = "doc_id", doc_text: str = "text", doc_lang: str = "lang",
) -> DataFrame:
    """Per page its id, ``lang``, ``probability``, ``text_lang`` (by text alone), ``declared`` and ``host``."""
    spark = pages.sparkSession
    small_batches(spark)
    langs, model = fit_text(docs, doc_id, doc_text, doc_lang)
    n = len(langs)
    rows = inputs(pages, id=id, url=url, html=html)
    kind = rows.schema["id"].dataType.simpleString()
    if not n:
        none = F.lit(None).cast("string")
        return rows.select(F.col("id").alias(id), none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), none.alias("declared"), none.alias("host"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, BATCH_BYTES):
            said, where, text = [], [], []
            for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                slots = grams(visible(h or ""))
                logs = shared.value[:, slots].sum(axis=1) * min(1.0, EFFECTIVE / max(1, len(slots)))
                text.append(logs - logs.max())
                said.append(declared(h or ""))
                where.append(address(u))
            columns = [pa.array(said, pa.string()), *(pa.array([w[i] for w in where], pa.string()) for i in range(3)), pa.array(text, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "declared", "host", "domain", "suffix", "text"])

    seen = stored(rows.mapInArrow(run, f"id {kind}, declared string, host string, domain string, suffix string, text array<double>"))
    raw = F.transform("text", lambda x: F.exp(x))
    seen = seen.withColumn("p", F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, y: a + y)))
    sums = F.array(*[F.sum(F.col("p")[i]) for i in range(n)])
    overall = seen.agg(sums.alias("s"), F.count("*").alias("n")).first()
    if not overall.n:
        totals, count = [0.0] * n, 1.0
    else:
        totals, count = list(overall.s), float(overall.n)
    out = seen
    for key in ("declared", "suffix"):
        by_value = seen.filter(F.col(key).isNotNull()).groupBy(key).agg(sums.alias("s"))
        out = out.join(_evidence(by_value, key, n, totals, count), F.col(key) == F.col(f"{key}_"), "left").drop(f"{key}_")
    for key in ("domain", "host"):
        by_value = seen.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(sums.alias(f"s_{key}"))
        out = out.join(by_value, F.col(key) == F.col("k"), "left").drop("k")
    scores = []
    for i in range(n):
        prior = F.lit((totals[i] + 1.0) / (count + n))
        for key in ("domain", "host"):
            others = F.aggregate(f"s_{key}", F.lit(-1.0), lambda a, x: a + x)  # all pages of the key but this one
            own = (F.col(f"s_{key}")[i] - F.col("p")[i] + STRENGTH * prior) / (others + STRENGTH)
            prior = F.when(own.isNull(), prior).otherwise(F.greatest(own, F.lit(1e-9)))  # greatest() skips NULLs
        told = [F.coalesce(F.col(f"e_{key}")[i], F.lit(0.0)) for key in ("declared", "suffix")]
        scores.append(F.col("text")[i] + told[0] + told[1] + F.log(prior))
    out = out.withColumn("score", F.array(*scores))
    best = F.array_max("score")
    name = F.array(*map(F.lit, langs))
    total = F.aggregate(F.transform("score", lambda x: F.exp(x - best)), F.lit(0.0), lambda a, x: a + x)
    pick = lambda column, top: F.element_at(name, F.array_position(column, top).cast("int"))
    return out.select(
        F.col("id").alias(id),
        pick(F.col("score"), best).alias("lang"),
        (1 / total).alias("probability"),
        pick(F.col("text"), F.array_max("text")).alias("text_lang"),
        "declared",
        "host",
    )
