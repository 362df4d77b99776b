"""Files that are one long JSON array, each read by many tasks.

Spark's text reader cuts a file at every ``}`` in parallel, wherever files are that Spark can read, but a task cannot know
whether its part begins inside a string, or how deep. So the parts are read twice. First each says how it would end for
each way it may begin (inside a string or not, after a backslash or not), and how much deeper; these are put together
in order, a row for each part. Then each part, told how it begins, cuts out the elements: the texts between commas
at the depth of the array, as strings and escapes allow. What a part has of elements that reach into other parts is joined by
the part they began in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestrata.functions.columns import fresh
from lakestrata.sources.files import CORRUPT, files_of

CUT = b"}"
QUOTE, BACKSLASH, COMMA, OPEN, CLOSE = b'"\\,[]'
_DEEPER = np.zeros(256, np.int64)
_DEEPER[list(b"[{")] = 1
_DEEPER[list(b"]}")] = -1
HEAD, TAIL, MIDDLE = 1, 2, 3


def scan(data: np.ndarray, inside: bool, escaped: bool) -> tuple[np.ndarray, bool, bool]:
    """Which bytes are outside strings, and whether the data ends inside one and after an unpaired backslash."""
    at = np.arange(len(data))
    before = np.maximum.accumulate(np.where(data == BACKSLASH, -1, at))  # the last byte that is no backslash
    before = np.where(before < 0, -2 if escaped else -1, before)
    last = np.append(-2 if escaped else -1, before)[:-1]
    quote = (data == QUOTE) & ((at - 1 - last) % 2 == 0)
    within = (np.cumsum(quote) + inside) % 2 == 1
    ends_escaped = bool((len(data) - 1 - before[-1]) % 2) if len(data) else escaped
    return ~within & ~quote, bool(within[-1]) if len(data) else inside, ends_escaped


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The texts between closing braces, with file, first byte of the part, and bytes of the file."""
    rows = spark.read.option("lineSep", CUT.decode()).text(path)
    names = {"file_path": "file", "file_block_start": "start", "file_size": "size"}
    return rows.select(*[F.col(f"_metadata.{old}").alias(new) for old, new in names.items()], F.col("value").cast("binary").alias("piece"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Batches cut where another part of a file begins."""
    for batch in batches:
        if not batch.num_rows:
            continue
        start, file = batch.column(1).to_numpy(), batch.column(0).dictionary_encode().indices.to_numpy()
        new = np.flatnonzero((np.diff(start) != 0) | (np.diff(file) != 0)) + 1
        cuts = [0, *new.tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield (batch.column(0)[a].as_py(), int(start[a])), batch.slice(a, b - a)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part its bytes, its first byte that is no blank, and by how it begins, how it ends and how much deeper.

    The four ways it may begin have the numbers 2 * (inside a string) + (after a backslash).
    """
    now, found = None, {}

    def row() -> pa.RecordBatch:
        ends = [2 * inside + escaped for inside, escaped, _ in found["ways"]]
        deeper = [d for _, _, d in found["ways"]]
        values = [*now, found["size"], found["bytes"], found["first"], ends, deeper]
        return pa.RecordBatch.from_pylist([dict(zip(SUMMARY.names, values, strict=True))], SUMMARY)

    for part, batch in _parts(batches):
        if part != now:
            if now is not None:
                yield row()
            now = part
            found = {"size": batch.column(2)[0].as_py(), "bytes": 0, "first": "", "ways": [(i, e, 0) for i in (False, True) for e in (False, True)]}
        data = CUT.join(batch.column(3).to_pylist()) + CUT
        found["bytes"] += len(data)
        found["first"] = found["first"] or data.lstrip()[:1].decode("latin-1")
        array = np.frombuffer(data, np.uint8)
        known = {}
        ways = []
        for inside, escaped, deep in found["ways"]:
            if (inside, escaped) not in known:
                outside, *end = scan(array, inside, escaped)
                known[inside, escaped] = (*end, int(_DEEPER[array[outside]].sum()))
            in_end, escaped_end, more = known[inside, escaped]
            ways.append((in_end, escaped_end, deep + more))
        found["ways"] = ways
    if now is not None:
        yield row()


SUMMARY = pa.schema(
    [("file", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("bytes", pa.int64()), ("first", pa.string())]
    + [("ends", pa.list_(pa.int32())), ("deeper", pa.list_(pa.int64()))]
)


def _begun(parts: pd.DataFrame) -> pd.DataFrame:
    """How each part of a file begins, from how the ones before it end."""
    parts = parts.sort_values("start")
    way, depth, ways, depths = 0, 0, [], []
    for ends, deeper in zip(parts["ends"], parts["deeper"], strict=True):
        ways.append(way)
        depths.append(depth)
        way, depth = int(ends[way]), depth + int(deeper[way])
    last = parts["start"] == parts["start"].max()
    # the text after the last brace has none of its own, unless the file ends with one
    extra = parts["bytes"].sum() - parts["size"]
    if parts["first"].iloc[0] not in ("[", ""):
        raise ValueError(f"no JSON array: {parts['file'].iloc[0]}")
    return pd.DataFrame(
        {"file": parts["file"], "start": parts["start"], "way": ways, "depth": depths, "surplus": np.where(last, extra, 0)}
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements of each part, and what it has of elements that began before it or end after it.

    Columns: file, start, piece, way, depth, surplus; the last row of a part is told by the next part or the end.
    """
    now, held, open_, seen = None, None, [], False
    inside = escaped = False
    depth = surplus = 0

    def rows(edges: list[int], texts: list[bytes]) -> pa.RecordBatch:
        n = len(texts)
        arrays = [pa.array([now[0]] * n, pa.string()), pa.array([now[1]] * n, pa.int64()), pa.array(edges, pa.int32()), pa.array(texts, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["file", "start", "edge", "record"])

    def feed(data: bytes) -> tuple[list[int], list[bytes]]:
        nonlocal inside, escaped, depth, open_, seen
        array = np.frombuffer(data, np.uint8)
        outside, inside, escaped = scan(array, inside, escaped)
        change = np.where(outside, _DEEPER[array], 0)
        after = depth + np.cumsum(change)
        depth = int(after[-1]) if len(after) else depth
        border = outside & (((array == COMMA) & (after == 1)) | ((array == OPEN) & (after == 1)) | ((array == CLOSE) & (after == 0)))
        edges, texts, begin = [], [], 0
        for at in np.flatnonzero(border).tolist():
            texts.append(b"".join([*open_, data[begin:at]]))
            edges.append(0 if seen else HEAD)
            open_, seen, begin = [], True, at + 1
        open_.append(data[begin:])
        return edges, texts

    def finish() -> Iterator[pa.RecordBatch]:
        if now is not None:
            edges, texts = feed(held[: len(held) - surplus])
            texts.append(b"".join(open_))
            edges.append(TAIL if seen else MIDDLE)
            yield rows(edges, texts)

    for part, batch in _parts(batches):
        if part != now:
            yield from finish()
            now, held, open_, seen = part, b"", [], False
            way, depth, surplus = (batch.column(i)[0].as_py() for i in (3, 4, 5))
            inside, escaped = way >= 2, way % 2 == 1
        yield rows(*feed(held))
        held = CUT.join(batch.column(2).to_pylist()) + CUT
    yield from finish()


def _bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(text: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"value": [text]})

    yield row("[")
    for batch in batches:
        yield batch.filter(batch.column(0).is_valid())
    yield row("0]")


def write_json_array(texts: DataFrame, path: str) -> None:
    """Write a column of element texts as one file that is one array on one line, a ``0`` for its last element.

    The one task that a single file takes passes the elements on as they come, whatever their number, and sorts nothing. NULLs are
    left out.
    """
    elements = texts.toDF("value").select(F.concat("value", F.lit(",")).alias("value"))
    none = texts.sparkSession.range(1).select(F.lit(None).cast("string").alias("value"))  # so that there is always a task
    elements.unionByName(none).coalesce(1).mapInArrow(_bracketed, "value string").write.option("lineSep", " ").text(path)


def elements(spark: SparkSession, path: str) -> DataFrame:
    """The texts of all elements of the arrays in some files (a folder or pattern), with their ``file``.

    An element that is empty is left out. An array that is not closed ends with its file; a file that does not start
    with a bracket is an error. An element whose own brackets or quotes do not close takes what follows with it.
    """
    read = pieces(spark, path)
    parts = read.select("file", "start", "size", "piece").mapInArrow(
        _summaries, "file string, start long, size long, bytes long, first string, ends array<int>, deeper array<long>"
    )
    begun = parts.groupBy("file").applyInPandas(_begun, "file string, start long, way int, depth long, surplus long")
    known = read.join(F.broadcast(begun), ["file", "start"])  # a row for each part of a file
    found = known.select("file", "start", "piece", "way", "depth", "surplus").mapInArrow(
        _cut, "file string, start long, edge int, record binary"
    )
    whole = found.filter("edge = 0").select("file", "record")
    # a tail begins an element that the heads and middles after it go on with
    order = Window.partitionBy("file").orderBy("start", "edge")
    split = found.filter("edge > 0").withColumn("begun", F.sum(F.when(F.col("edge") == TAIL, 1).otherwise(0)).over(order))
    joined = split.groupBy("file", "begun").agg(F.array_sort(F.collect_list(F.struct("start", "edge", "record"))).alias("all"))
    text = F.aggregate("all", F.lit(b""), lambda text, x: F.concat(text, x["record"]))
    records = whole.unionByName(joined.select("file", text.alias("record")))
    trimmed = F.trim(F.col("record").cast("string"), F.lit(" \t\r\n"))
    return records.select("file", trimmed.alias("record")).filter("record <> ''")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, fail_fast: bool = False, **options: str) -> DataFrame:
    """The elements of the array files of a folder as rows, the text of each that is no such object in ``_corrupt_record``."""
    corrupt = fresh(CORRUPT, schema.names)
    kind = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    text = elements(spark, files_of(path, "json"))
    row = F.from_json("record", kind, {**options, "columnNameOfCorruptRecord": corrupt})
    parsed = text.select("record", F.when(F.col("record").startswith("{") & F.col("record").endswith("}"), row).alias("row"))
    bad = F.when(F.col("row").isNull() | F.col(f"row.{corrupt}").isNotNull(), F.col("record"))
    if fail_fast:
        bad = F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("malformed element: "), bad)).cast("string"))
    return parsed.select(*[F.col("row").getField(n).alias(n) for n in schema.names], bad.alias(CORRUPT))
