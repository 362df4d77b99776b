"""Quotation linking: who answers whom in a conversation, and the messages without what they quote.

A line that begins with ``>`` is a quotation; each ``>``, blanks between them aside, is one level. A passage is a run
of lines of one level; a blank line within it belongs to it. Passages and the messages' own paragraphs are normalised
(lower case, runs of blanks as one, outer blanks and punctuation dropped) and hashed; a passage is joined to the
latest earlier message of its conversation that wrote that paragraph itself, or else the whole of its text. A message
replies to the author of its outermost quotation that is found (the first such passage), otherwise to the message
before it. What is nested deeper is joined to its own author and reported, but does not decide the reply.

Order in a conversation is by turn (null first), then role, then text. A row that repeats another one is a message of its own.
Null texts are empty. A conversation is never gathered in one place: places come from one sort of all rows, passages
meet only paragraphs of their hash. A run of messages that each answer the one before is one segment; depth and the
order of replies are found for segments, by doubling over a tour of their tree, and counted on within them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakestrata.llm.frames import inputs, small_batches, stored

QUOTE = re.compile(r"^[ \t]*((?:>[ \t]*)+)")
SPAN = 16
OUTER = " \t\r\n.,;:!?\"'()[]*_-"


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotations, and its passages with their levels, in order."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    open_ = False
    for line in text.split("\n"):
        found = QUOTE.match(line)
        if found is None:
            own.append(line)
            open_ = False
            continue
        level, rest = found[1].count(">"), line[found.end() :]
        if open_ and (passages[-1][0] == level or not rest.strip()):
            passages[-1][1].append(rest)
        elif rest.strip():
            passages.append((level, [rest]))
            open_ = True
    left = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n") if passages else text
    return left, [(level, "\n".join(lines).rstrip("\n")) for level, lines in passages]


def normal(text: str) -> str:
    return " ".join(text.lower().split()).strip(OUTER)


def paragraphs(text: str) -> list[str]:
    """The distinct normal forms a quotation of the text may have: its whole, its paragraphs and its lines."""
    parts = [text, *re.split(r"\n[ \t]*\n", text), *text.split("\n")]
    return sorted({n for n in map(normal, parts) if n})


def link(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Messages and passages.

    Messages: ``conv``, ``turn``, ``role``, ``position`` (from 1), ``reply_to`` (a position, null at a start),
    ``depth`` of replies (0 at a start), ``rank`` (from 1) in reply order, in which a message comes after what it answers
    and, before the next answer to that, is followed by its own answers, ``n_quotes``, ``n_linked`` and ``text`` without quotations. Passages: ``conv``,
    ``position``, ``nth``, ``level``, ``passage`` and ``source`` (a position, null where none is found).
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = inputs(df, conv=conv, turn=turn, role=role, text=text)
    placed = _placed(rows)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(t or "") for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            quotes = [[{"level": level, "passage": p, "normal": normal(p)} for level, p in f[1]] for f in found]
            kind = pa.list_(pa.struct([("level", pa.int32()), ("passage", pa.string()), ("normal", pa.string())]))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("conv", "turn", "role", "position", "n")]
            arrays = [
                pa.array([f[0] for f in found], pa.string()),
                pa.array([paragraphs(f[0]) for f in found], pa.list_(pa.string())),
                pa.array(quotes, kind),
            ]
            yield pa.RecordBatch.from_arrays([*columns, *arrays], ["conv", "turn", "role", "position", "n", "text", "said", "quotes"])

    schema = f"conv {kinds['conv']}, turn {kinds['turn']}, role {kinds['role']}, position long, n long, text string"
    schema += ", said array<string>, quotes array<struct<level: int, passage: string, normal: string>>"
    parsed = stored(placed.select("conv", "turn", "role", "position", "n", "text").mapInArrow(read, schema))

    quoted = parsed.select("conv", "position", F.posexplode("quotes").alias("nth", "q"))
    quoted = quoted.select("conv", "position", "nth", "q.*")
    # only conversations with quotations send their paragraphs
    with_quotes = parsed.filter(F.size("quotes") > 0).select(F.col("conv").alias("c")).distinct()
    said = parsed.join(with_quotes, F.col("conv").eqNullSafe(F.col("c")), "left_semi")
    said = said.select("conv", "position", F.explode("said").alias("normal"))
    # passages and paragraphs of one hash in order; a passage takes the last paragraph before its message
    hash_ = F.sha2("normal", 256).alias("hash")
    both = quoted.filter("normal != ''").select("conv", hash_, "position", "nth", F.lit(None).cast("long").alias("at"))
    both = both.unionByName(said.select("conv", hash_, "position", F.lit(None).cast("int").alias("nth"), F.col("position").alias("at")))
    order = Window.partitionBy("conv", "hash").orderBy("position", F.col("nth").asc_nulls_last())
    latest = F.last("at", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sources = both.withColumn("source", latest).filter("nth IS NOT NULL AND source IS NOT NULL")
    s = sources.select(F.col("conv").alias("c"), F.col("position").alias("p"), F.col("nth").alias("n"), "source")
    on = F.col("conv").eqNullSafe(F.col("c")) & (F.col("position") == F.col("p")) & (F.col("nth") == F.col("n"))
    passages = stored(quoted.join(s, on, "left").select("conv", "position", "nth", "level", "passage", "source"))

    found = passages.filter("source IS NOT NULL")
    first = found.groupBy("conv", "position").agg(F.min(F.struct("level", "nth", "source"))["source"].alias("source"), F.count("*").alias("n_linked"))
    first = first.select(F.col("conv").alias("c"), F.col("position").alias("p"), "source", "n_linked")
    on = F.col("conv").eqNullSafe(F.col("c")) & (F.col("position") == F.col("p"))
    before = F.when(F.col("position") > 1, F.col("position") - 1)
    messages = parsed.join(first, on, "left").select(
        "conv",
        "turn",
        "role",
        "position",
        "n",
        F.coalesce("source", before).alias("reply_to"),
        F.size("quotes").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "text",
    )
    return _in_reply_order(stored(messages)).withColumnsRenamed({"conv": conv, "turn": turn, "role": role, "text": text}), passages


def _numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows with their place ``n`` (from 0) in the order of the keys: sorted all over, numbered by partition."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ordered = stored(ordered.withColumn("n", F.monotonically_increasing_id()))
    part, within = F.shiftright("n", 33), F.col("n").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r.part: r["count"] for r in ordered.groupBy(part.alias("part")).count().collect()}
    before, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    offset = F.element_at(F.lit(before or [0]).cast("array<long>"), part.cast("int") + 1)
    return ordered.withColumn("n", within + offset)


def _placed(rows: DataFrame) -> DataFrame:
    """The rows with their place ``n`` among all and their ``position``, the place less their conversation's first."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    # a large conversation is many partitions
    numbered = _numbered(rows.withColumn("digest", digest), "conv", "turn", "role", "digest")
    first = numbered.groupBy(F.col("conv").alias("c")).agg(F.min("n").alias("first"))
    placed = numbered.join(first, F.col("conv").eqNullSafe(F.col("c")))
    return placed.withColumn("position", F.col("n") - F.col("first") + 1)


def _in_reply_order(messages: DataFrame) -> DataFrame:
    """The messages with ``depth`` and ``rank``."""
    rows = messages.select("n", (F.col("n") - F.col("position") + F.col("reply_to")).alias("up"))
    branches = rows.filter("up < n - 1")
    if branches.isEmpty():  # each conversation is one segment
        return messages.withColumn("depth", F.col("position") - 1).withColumn("rank", F.col("position")).drop("n")
    rows = stored(_with_heads(rows))
    segments = rows.groupBy(F.col("head").alias("v")).agg(F.count("*").alias("size"))
    owner = rows.select(F.col("n").alias("at"), F.col("head").alias("parent"))
    branches = rows.filter("n = head AND up IS NOT NULL").select(F.col("n").alias("v"), "up").join(owner, F.col("up") == F.col("at"))
    # the rest of a segment comes before its branches, and those further down before those further up
    branches = stored(_numbered(branches.select("v", "parent", (F.col("up") - F.col("parent") + 1).alias("down"), (-F.col("up")).alias("order")), "parent", "order", "v"))
    after = branches.select((F.col("n") - 1).alias("i"), F.col("parent").alias("same"), F.col("v").alias("next"))
    first = branches.groupBy(F.col("parent").alias("of")).agg(F.min_by("v", "n").alias("first"))
    nodes = segments.join(branches.select("v", "parent", "down", F.col("n").alias("i")), "v", "left").join(after, "i", "left")
    nodes = nodes.withColumn("next", F.when(F.col("same") == F.col("parent"), F.col("next")))
    nodes = nodes.join(first, F.col("v") == F.col("of"), "left").withColumn("down", F.coalesce("down", F.lit(0)))
    nodes = stored(nodes.filter("parent IS NOT NULL OR first IS NOT NULL").select("v", "parent", "down", "size", "next", "first"))
    # a tour enters (2v) and leaves (2v + 1) every segment; each step adds up what lies before it
    enter = nodes.select(F.coalesce(F.col("first") * 2, F.col("v") * 2 + 1).alias("e"), (F.col("v") * 2).alias("up"), "size", "down")
    leave = nodes.select(F.coalesce(F.col("next") * 2, F.col("parent") * 2 + 1).alias("e"), (F.col("v") * 2 + 1).alias("up"), F.lit(0).cast("long").alias("size"), (-F.col("down")).alias("down"))
    start = nodes.filter("parent IS NULL").select((F.col("v") * 2).alias("e"), F.lit(None).cast("long").alias("up"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("down"))
    tour = stored(enter.unionByName(leave.filter("e IS NOT NULL")).unionByName(start))
    while not (open_ := tour.filter("up IS NOT NULL")).isEmpty():
        above = tour.select(F.col("e").alias("p"), F.col("up").alias("top"), F.col("size").alias("more"), F.col("down").alias("deeper"))
        step = open_.join(above, F.col("up") == F.col("p"))  # steps whose sum is known stay as they are
        step = step.select("e", F.col("top").alias("up"), (F.col("size") + F.col("more")).alias("size"), (F.col("down") + F.col("deeper")).alias("down"))
        tour = stored(step.unionByName(tour.filter("up IS NULL")))
    entered = tour.filter("e % 2 = 0").select(F.shiftright("e", 1).alias("v"), F.col("size").alias("before"), F.col("down").alias("above"))
    heads = nodes.select("v", "down").join(entered, "v").select("v", "before", (F.col("above") + F.col("down")).alias("deep"))
    found = rows.join(heads, F.col("head") == F.col("v"), "left")
    on = lambda c: F.coalesce(c, F.lit(0)) + F.col("n") - F.col("head")
    return messages.join(found.select("n", on("deep").alias("depth"), (on("before") + 1).alias("rank")), "n").drop("n")


def _with_heads(rows: DataFrame) -> DataFrame:
    """(n, up) and ``head``, the last place up to n that does not answer the one before it: found in spans of places."""
    rows = rows.withColumn("span", F.shiftright("n", SPAN)).withColumn("own", F.when(F.col("up").isNull() | (F.col("up") < F.col("n") - 1), F.col("n")))
    carried, last = [], None
    for r in rows.groupBy("span").agg(F.max("own").alias("own")).orderBy("span").collect():
        carried.append((r.span, last))
        last = last if r.own is None else r.own
    spans = rows.sparkSession.createDataFrame(carried, "at long, carried long")
    so_far = Window.partitionBy("span").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("own", F.last("own", ignorenulls=True).over(so_far)).join(F.broadcast(spans), F.col("span") == F.col("at"))
    return found.select("n", "up", F.coalesce("own", "carried").alias("head"))


def conversations(messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Messages in the order of their replies: ``path`` sorts a conversation so that answers follow what they answer."""
    return messages.withColumn("path", F.col("rank")).orderBy(conv, "path")
