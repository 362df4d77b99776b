"""Projections, range extraction, stamping, array bridges and key checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestrata.functions.columns import as_list, fresh, quoted, trailing_id


def rename_projection(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Keep exactly the listed columns under their new names, in the listed order."""
    return df.select(*[quoted(old).alias(new) for old, new in renames.items()])


def id_range(df: DataFrame, id_field: str, initial_id=None, final_id=None) -> DataFrame:
    """Rows with ``initial_id <= id <= final_id``; without bounds, all rows (a full load)."""
    if (initial_id is None) != (final_id is None):
        raise ValueError("give both bounds or neither")
    return df if initial_id is None else df.filter(quoted(id_field).between(initial_id, final_id))


def ingest_stamp(df: DataFrame, as_of: str, field: str = "updated_at") -> DataFrame:
    """Set one ISO stamp for the whole batch."""
    return df.withColumn(field, F.lit(as_of))


def explode_bridge(
    df: DataFrame,
    id_field: str,
    array_field: str,
    id_as: str,
    ref_as: str,
    keep: Mapping[str, str] | None = None,
    outer: bool = False,
    cast_to: str | None = None,
    empty_as_null: bool = False,
) -> DataFrame:
    """One row per (entity, referenced id) from an array of URLs.

    Entities with an empty or NULL array disappear unless ``outer`` is set.
    """
    explode = F.explode_outer if outer else F.explode
    kept = keep or {}
    id_, url = fresh("_id", kept), fresh("_url", kept)
    rows = df.select(quoted(id_field).alias(id_), explode(quoted(array_field)).alias(url),
                     *[quoted(c) for c in kept])
    return rows.select(
        quoted(id_).alias(id_as),
        trailing_id(quoted(url), cast_to, empty_as_null).alias(ref_as),
        *[quoted(old).alias(new) for old, new in kept.items()],
    )


def count_by(df: DataFrame, count_as: str, counted: Column | None = None, **groups: Column) -> DataFrame:
    """Rows (or non-NULL ``counted`` values) per group expression; partial counts before the shuffle."""
    counted = F.lit(1) if counted is None else counted
    return df.groupBy(*[c.alias(n) for n, c in groups.items()]).agg(F.count(counted).alias(count_as))


def duplicate_keys(df: DataFrame, keys: str | list[str], count_as: str = "n") -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    keys = as_list(keys)
    counts = df.groupBy(*[quoted(k) for k in keys]).agg(F.count(F.lit(1)).alias(count_as))
    return counts.filter(quoted(count_as) > 1)
