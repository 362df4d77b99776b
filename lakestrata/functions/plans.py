"""What Spark plans for a DataFrame, as far as the operators depend on it."""

from __future__ import annotations

import re
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows that one task should sort, join or write.
TASK_ROWS = 1 << 20
# Bytes that stand for a row in files whose rows are not counted, such as text.
ROW_BYTES = 128
# Plans that read fewer bytes are not asked for their rows.
_FEW_BYTES = 1 << 20

_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_LEAST = "spark.sql.adaptive.coalescePartitions.minPartitionNum"
_SPLITS = "spark.sql.files.minPartitionNum"
_LOCK = threading.Lock()
_HELD: dict = {}


def plan_text(df: DataFrame) -> str:
    """What ``explain`` prints; not by catching its output, as streams run side by side."""
    query = df._jdf.queryExecution()
    return df.sparkSession._jvm.PythonSQLUtils.explainString(query, "simple")


def estimated_bytes(df: DataFrame) -> int:
    """Bytes of the files a plan reads, or where Spark cannot tell, those of the rows as text."""
    spark = df.sparkSession
    unknown = int(spark._jsparkSession.sessionState().conf().defaultSizeInBytes())
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    if all(s < unknown for s in sizes):
        return sum(sizes)
    text = F.to_json(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns]))
    return df.agg(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0


def comes_from_shuffle_on(df: DataFrame, keys: list[str]) -> bool:
    """Whether the last shuffle is Spark's own on just these keys.

    There may be none where the input is already ordered or partitioned by them in another way.
    """
    found = re.search(r"Exchange (\w+)\((.*?), \d+\), (\w+)", plan_text(df))
    if not found or found.group(1, 3) != ("hashpartitioning", "ENSURE_REQUIREMENTS"):
        return False
    return re.sub(r"#\d+L?", "", found.group(2)).split(", ") == keys


def rows_read(df: DataFrame) -> int:
    """Rows of the parquet files, from their footers, and of the persisted rows that a plan reads, and one for each
    ``ROW_BYTES`` of other files.

    0 where those are few bytes, and for what Spark cannot tell: batches of streams, persisted results not computed yet.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    stats = [leaves.apply(i).stats() for i in range(leaves.size())]
    if sum(int(s.sizeInBytes()) for s in stats) < _FEW_BYTES:
        return 0
    counts = [s.rowCount() for s in stats]
    known = sum(int(str(c.get())) for c in counts if c.isDefined())
    files = [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(f)) for f in df.inputFiles()]
    counted = [f for f in files if f.endswith(".parquet")]
    others = [f for f in files if not f.endswith(".parquet")]
    reader = df.sparkSession.read.option("recursiveFileLookup", "true")
    if counted:
        known += reader.parquet(*counted).count()
    if others:
        known += int(reader.text(others)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // ROW_BYTES
    return known


def rows_streamed(batch: DataFrame) -> int:
    """One row for each ``ROW_BYTES`` of the files in a batch that a stream reads from files and nothing else."""
    conf = batch.sparkSession._jsparkSession.sessionState().conf()
    size = int(str(batch._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size // ROW_BYTES if _FEW_BYTES <= size < int(conf.defaultSizeInBytes()) else 0


@contextmanager
def dealt_by_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Meanwhile the session's scans and shuffles of so many rows make tasks of about ``TASK_ROWS``.

    AQE joins partitions by their compressed bytes, of which some rows take hundreds of times as many in a sort. The
    number of shuffle partitions is raised to a multiple of what it was, as :meth:`Table.shuffles_fit` asks for.
    Writes side by side share the greatest number, and the last restores the settings.
    """
    wanted = -(-rows // TASK_ROWS)
    if wanted < 2:
        yield
        return
    key = spark._jsparkSession

    def apply(before: dict, least: int) -> None:
        number = int(before[_INITIAL] or spark.conf.get("spark.sql.shuffle.partitions"))
        while number < 2 * least:
            number *= 2
        spark.conf.set(_INITIAL, number)
        for name in (_LEAST, _SPLITS):
            spark.conf.set(name, max(least, int(before[name] or spark.sparkContext.defaultParallelism)))

    with _LOCK:
        before, held = _HELD.setdefault(key, ({k: spark.conf.get(k, None) for k in (_INITIAL, _LEAST, _SPLITS)}, []))
        held.append(wanted)
        apply(before, max(held))
    try:
        yield
    finally:
        with _LOCK:
            held.remove(wanted)
            if held:
                apply(before, max(held))
            else:
                del _HELD[key]
                for name, value in before.items():
                    spark.conf.unset(name) if value is None else spark.conf.set(name, value)
