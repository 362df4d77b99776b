"""Latest row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakestrata.functions.columns import as_list, fresh, quoted, row_digest


def latest_per_key(
    df: DataFrame,
    keys: str | list[str],
    order_by: str | list[str],
    tie_breakers: str | list[str] | None = None,
) -> DataFrame:
    """Keep the row with the greatest ``order_by`` of each key, NULLs last.

    Filtering on ``row_number() = 1`` makes Spark cut each input partition to one row per key before
    the shuffle, so a hot key sends at most one row per map task. Equal orderings go to the
    tie-breakers and at last to a row hash, so that reruns and task retries agree.
    """
    ties = [quoted(c) for c in as_list(tie_breakers)] + [row_digest(df.schema)]
    order = [quoted(c).desc() for c in as_list(order_by)] + [c.desc() for c in ties]
    window = Window.partitionBy(*[quoted(k) for k in as_list(keys)]).orderBy(*order)
    rank = fresh("_rn", df.columns)
    return df.withColumn(rank, F.row_number().over(window)).filter(quoted(rank) == 1).drop(rank)


def latest_per_key_agg(
    df: DataFrame,
    keys: str | list[str],
    order_by: str | list[str],
    tie_breakers: str | list[str] | None = None,
) -> DataFrame:
    """The same rows by ``max_by``; unlike a window this also runs on a streaming DataFrame.

    As a stream it keeps a whole row for every key seen, so it is for bounded sets of keys.
    """
    ties = [quoted(c) for c in as_list(tie_breakers)] + [row_digest(df.schema)]
    rank = F.struct(*[quoted(c) for c in as_list(order_by)], *ties)
    row = F.struct(*[quoted(c) for c in df.columns])
    grouped = df.groupBy(*[quoted(k).alias(f"_key{i}") for i, k in enumerate(as_list(keys))])
    return grouped.agg(F.max_by(row, rank).alias("_row")).select("_row.*")
