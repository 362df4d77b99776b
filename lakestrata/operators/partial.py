"""Aggregates kept as mergeable parts, one set for each bucket of the table they are taken from."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestrata.functions.columns import fresh, quoted
from lakestrata.operators.affected import changed_partitions
from lakestrata.sources.tables import BUCKET, Table

PART = "part"
#: How rows are taken into a part, and parts into the whole.
MEASURES = {"count": (F.count, F.sum), "sum": (F.sum, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}


def refresh_parts(parts: Table, source: Table, group_by: Mapping[str, str], measures: Mapping[str, tuple[str, str]]) -> list[str]:
    """Work out the parts of the buckets that changed since the last run, and name these buckets.

    ``group_by`` gives a source expression for each group column, ``measures`` a kind (count, sum, min, max) and an
    expression for each value. A table without buckets, and one read for the first time or by other definitions, is read
    whole.
    """
    clash = {n.lower() for n in [*group_by, *measures]} & {PART, BUCKET}
    unknown = {kind for kind, _ in measures.values()} - MEASURES.keys()
    if clash or unknown:
        raise ValueError(f"names that parts need: {sorted(clash)}; unknown measures: {sorted(unknown)}")
    meta, stored = source.meta(), parts.meta()
    definition = hashlib.sha256(repr((sorted(group_by.items()), sorted(measures.items()))).encode()).hexdigest()[:16]
    name = f"parts:{source.path}"
    version, defined = (stored or {}).get("marks", {}).get(name, (None, None))
    seen = version if defined == definition else None
    old = None if seen is None else source.at(seen)
    if seen == meta["version"]:
        return []
    bucketed = meta["partition_by"] == BUCKET
    whole = old is None or not bucketed or old["partition_by"] != BUCKET
    changed = sorted(meta["live"]) if whole else changed_partitions(old, meta)
    rows = source.read(changed, with_bucket=bucketed, meta=meta)
    bucket = quoted(BUCKET) if bucketed else F.lit(0)
    kept = fresh("_part", rows.columns)
    keys = [F.expr(e).alias(n) for n, e in group_by.items()]
    values = [F.expr(e).alias(f"_{i}") for i, (_, e) in enumerate(measures.values())]
    taken = rows.select(bucket.cast("int").alias(kept), *keys, *values)
    found = taken.groupBy(kept, *[quoted(n) for n in group_by]).agg(
        *[MEASURES[kind][0](f"_{i}").alias(n) for i, (n, (kind, _)) in enumerate(measures.items())]
    )
    found = found.withColumnRenamed(kept, PART)
    parts.mark = (name, (meta["version"], definition))
    if whole:
        parts.overwrite(found, partition_by=PART)
    elif changed:
        parts.replace(found, [p.replace(f"{BUCKET}=", f"{PART}=") for p in changed])
    else:
        parts.publish_mark()
    return changed


def combined(parts: Table, group_by: Mapping[str, str], measures: Mapping[str, tuple[str, str]]) -> DataFrame:
    """The aggregate of the whole table from its parts."""
    whole = []
    for name, (kind, _) in measures.items():
        value = MEASURES[kind][1](quoted(name))
        whole.append((F.coalesce(value, F.lit(0)) if kind == "count" else value).cast(parts.schema[name].dataType).alias(name))
    return parts.read().groupBy(*[quoted(n) for n in group_by]).agg(*whole)
