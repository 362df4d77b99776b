"""Groups of a stored table that changed between two of its versions, and tables kept up to date by them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestrata.functions.columns import any_null, fresh, quoted, row_identity
from lakestrata.sources.tables import BUCKET, Table


def changed_partitions(old: dict, new: dict) -> list[str]:
    """Partitions whose files differ between two versions, also those that only one of them has."""
    return sorted(p for p in old["live"].keys() | new["live"].keys() if old["live"].get(p) != new["live"].get(p))


def affected_groups(table: Table, old: dict, new: dict, group_by: Mapping[str, str]) -> DataFrame:
    """Keys of the groups that have a row in one version and not in the other, as named in ``group_by``.

    Only changed partitions are read, each row goes through the shuffle as its key and two hashes, and rows that were
    rewritten as they are cancel out there.
    """
    partitions = changed_partitions(old, new)
    one, two, turn = (fresh(n, group_by) for n in ("_one", "_two", "_turn"))
    keys = [F.expr(e).alias(n) for n, e in group_by.items()]
    sides = []
    for meta, sign in ((old, -1), (new, 1)):
        rows = table.read(partitions, meta=meta)
        told = row_identity(rows.schema, [one, two])
        sides.append(rows.select(*keys, *[c.alias(n) for n, c in told.items()], F.lit(sign).alias(turn)))
    names = [quoted(n) for n in group_by]
    counted = sides[0].unionByName(sides[1]).groupBy(*names, one, two).agg(F.sum(turn).alias(turn))
    return counted.filter(quoted(turn) != 0).select(*names).distinct()


def rows_of_groups(table: Table, meta: dict, group_by: Mapping[str, str], groups: DataFrame) -> DataFrame:
    """All rows of some groups, read from the buckets that hold any: first the columns that make the key, then these."""
    marked = {n: fresh(f"_g{i}", table.schema.names) for i, n in enumerate(group_by)}
    renamed = groups.withColumnsRenamed(marked)
    match = reduce(lambda a, b: a & b, [F.expr(e).eqNullSafe(quoted(marked[n])) for n, e in group_by.items()])
    partitions = None
    if meta["bucket_by"]:
        hits = table.read(with_bucket=True, meta=meta).join(renamed, match, "left_semi")
        spread = hits.select(BUCKET).distinct().collect()  # at most a row for each bucket
        partitions = [f"{BUCKET}={r[BUCKET]}" for r in spread]
    return table.read(partitions, meta=meta).join(renamed, match, "left_semi")


def refresh_groups(
    target: Table,
    source: Table,
    group_by: Mapping[str, str],
    transform: Callable[[DataFrame], DataFrame],
    buckets: int | None = None,
) -> None:
    """Keep ``target`` equal to ``transform`` of ``source``, by the groups that changed since it was last read.

    ``group_by`` names columns of the target and gives the expression of source columns that each is. Every row of the
    result must depend on the source rows of its own group alone. Groups without rows any more disappear. The first
    run, and one for which the old version is gone or has another schema, transforms everything.
    """
    meta, keys = source.meta(), list(group_by)
    name = f"groups:{source.path}"
    seen = (target.meta() or {}).get("marks", {}).get(name)
    if seen == meta["version"]:
        return
    target.mark = (name, meta["version"])
    old = None if seen is None else source.at(seen)
    if old is None or old["schema"] != meta["schema"] or target.meta()["bucket_by"] != keys:
        target.overwrite(transform(source.read(meta=meta)), keys, buckets)
        return
    groups = affected_groups(source, old, meta, group_by).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if groups.isEmpty():
            target.publish_mark()
            return
        stored, kinds = target.meta(), target.schema
        cast = groups.select(*[quoted(k).cast(kinds[k].dataType).alias(k) for k in keys])
        if cast.filter(any_null(keys)).isEmpty():
            spread = target.bucketed(cast, stored).select(BUCKET).distinct().collect()  # at most a row for each bucket
            touched = [f"{BUCKET}={r[BUCKET]}" for r in spread]
        else:
            touched = [f"{BUCKET}={i}" for i in range(stored["buckets"])]  # rows with a NULL key lie anywhere
        new = transform(rows_of_groups(source, meta, group_by, groups))
        kept = target.read(touched).alias("t").join(cast.alias("g"), _same(keys), "left_anti")
        target.replace(kept.unionByName(new.select(*[quoted(n).cast(kinds[n].dataType).alias(n) for n in kinds.names])), touched)
    finally:
        groups.unpersist()


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [quoted(k, "t").eqNullSafe(quoted(k, "g")) for k in keys])
