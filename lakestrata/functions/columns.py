"""Column helpers shared by the operators."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_IN_WORDS = "MMMM d, yyyy"
TRAILING_DIGITS = r"/(\d+)$"


def as_list(names: str | Iterable[str] | None) -> list[str]:
    if names is None:
        return []
    return [names] if isinstance(names, str) else list(names)


def fresh(name: str, *taken: Iterable[str]) -> str:
    """A name that none of the given lists of columns has, in any case."""
    used = {c.lower() for names in taken for c in names}
    while name.lower() in used:
        name += "_"
    return name


def quoted(name: str, alias: str | None = None) -> Column:
    return F.col(f"{alias}.`{name}`" if alias else f"`{name}`")


def trailing_id(url: Column | str, cast_to: str | None = None, empty_as_null: bool = False) -> Column:
    """Digits after the last slash of a URL.

    As with ``regexp_extract``, a URL without them gives ``''`` unless ``empty_as_null`` is set.
    """
    found = F.regexp_extract(url, TRAILING_DIGITS, 1)
    if empty_as_null or cast_to:
        found = F.nullif(found, F.lit(""))
    return found.cast(cast_to) if cast_to else found


def parse_day(text: Column | str, pattern: str = DAY_IN_WORDS, tolerant: bool = False) -> Column:
    """Textual day to date; ``tolerant`` gives NULL for malformed text also under ANSI mode."""
    if tolerant:
        return F.try_to_date(text, pattern)
    return F.to_date(text, pattern)


def year_of(text: Column | str, pattern: str = DAY_IN_WORDS, tolerant: bool = False) -> Column:
    return F.year(parse_day(text, pattern, tolerant))


def iso_day(day: str | dt.date) -> str:
    """Check a day and give it as ``YYYY-MM-DD``; a missing day is an error, never "all rows"."""
    if isinstance(day, dt.datetime):
        day = day.date()
    return day.isoformat() if isinstance(day, dt.date) else dt.date.fromisoformat(day).isoformat()


def day_filters(field: T.StructField, day: str | dt.date) -> tuple[Column, Column]:
    """Conditions for a date, timestamp or ISO text column to lie on a day, and not to.

    A NULL does not lie on the day. Both are plain comparisons, which parquet scans can push down.
    """
    start = dt.date.fromisoformat(iso_day(day))
    column, low = quoted(field.name), F.lit(start.isoformat())
    if isinstance(field.dataType, T.DateType):
        low = F.lit(start)
        return column == low, (column != low) | column.isNull()
    high = F.lit((start + dt.timedelta(days=1)).isoformat())
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        low, high = [x.cast(field.dataType) for x in (low, high)]
    # ISO text orders as its dates do.
    return (column >= low) & (column < high), (column < low) | (column >= high) | column.isNull()


def hashable(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.StructType):
        return all(hashable(f.dataType) for f in data_type.fields)
    if isinstance(data_type, T.ArrayType):
        return hashable(data_type.elementType)
    return not isinstance(data_type, (T.MapType, T.VariantType))


def nullable(data_type: T.DataType) -> T.DataType:
    """The same type with everything nullable, as parquet scans report it."""
    if isinstance(data_type, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType)) for f in data_type.fields])
    if isinstance(data_type, T.ArrayType):
        return T.ArrayType(nullable(data_type.elementType))
    if isinstance(data_type, T.MapType):
        return T.MapType(data_type.keyType, nullable(data_type.valueType))
    return data_type


def _digested(column: Column, data_type: T.DataType) -> Column | None:
    """The column in a form that hashes: maps by their sorted entries."""
    if hashable(data_type):
        return column
    if isinstance(data_type, T.MapType) and hashable(data_type.keyType) and hashable(data_type.valueType):
        return F.array_sort(F.map_entries(column))
    return F.to_json(F.struct(column.alias("c"))) if not isinstance(data_type, T.VariantType) else None


def row_digest(schema: T.StructType, alias: str | None = None, seed: int | None = None) -> Column:
    """64-bit hash of a row, to order equal timestamps the same way on every run and retry."""
    found = [_digested(quoted(f.name, alias), f.dataType) for f in schema.fields]
    columns = [c for c in found if c is not None] + ([] if seed is None else [F.lit(seed)])
    return F.xxhash64(*columns) if columns else F.lit(0).cast("bigint")


def row_identity(schema: T.StructType, names: list[str], alias: str | None = None) -> dict[str, Column]:
    """Two 64-bit hashes that tell rows apart, also rows that hold the same values beside other NULLs.

    Spark's hashes pass over NULLs, so where they stand is hashed as well.
    """
    told = []
    for field in schema.fields:
        column = quoted(field.name, alias)
        if isinstance(field.dataType, (T.StructType, T.ArrayType)):
            told.append(F.to_json(F.struct(column.alias("c")), {"ignoreNullFields": "false"}))
        elif (digested := _digested(column, field.dataType)) is not None:
            told += [digested, column.isNull()]
    return {name: F.xxhash64(*told, F.lit(seed)) for seed, name in enumerate(names, 1)}


def any_null(keys: list[str]) -> Column:
    """Whether a key has a NULL part and so matches nothing."""
    return reduce(lambda a, b: a | b, [quoted(k).isNull() for k in keys])


def bucket_of(schema: T.StructType, keys: list[str], buckets: int) -> Column:
    """Bucket of a row: the partition a shuffle on the keys into as many partitions puts it in.

    Rows with a NULL key match nothing, so a row hash spreads them over all buckets.
    """
    spread = F.hash(row_digest(schema))
    hashed = F.when(any_null(keys), spread).otherwise(F.hash(*[quoted(k) for k in keys]))
    return F.pmod(hashed, F.lit(buckets)).cast("int")


_WHOLE = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]


def _keeps_values(have: T.DataType, want: T.DataType) -> bool:
    """Whether a plain cast keeps every value, or rounds it as storing it as a float must."""
    if isinstance(have, T.NullType) or isinstance(want, T.StringType):
        return True
    if type(have) in _WHOLE:
        if type(want) in _WHOLE:
            return _WHOLE.index(type(have)) <= _WHOLE.index(type(want))
        if isinstance(want, T.DecimalType):
            return want.precision - want.scale >= [3, 5, 10, 19][_WHOLE.index(type(have))]
        return isinstance(want, T.DoubleType) and not isinstance(have, T.LongType)
    if isinstance(have, T.DecimalType) and isinstance(want, T.DecimalType):
        return want.scale >= have.scale and want.precision - want.scale >= have.precision - have.scale
    times = (T.DateType, T.TimestampNTZType, T.TimestampType)
    if isinstance(have, T.DateType) and isinstance(want, times):
        return True
    return isinstance(have, (T.FloatType, T.DoubleType)) and isinstance(want, (T.FloatType, T.DoubleType))


def assigned(column: Column, have: T.DataType, want: T.DataType) -> Column:
    """The value in another type; one that the type cannot hold is an error in every session."""
    if _keeps_values(have, want):
        return column.cast(want)
    held = column.try_cast(want)
    same = held.isNotNull()
    if not isinstance(have, T.StringType):
        same = same & held.try_cast(have).eqNullSafe(column)
    error = F.concat(F.lit(f"{have.simpleString()} value is no {want.simpleString()}: "), column.cast("string"))
    return F.when(column.isNull() | same, held).otherwise(F.raise_error(error).cast(want))


def wider(one: T.DataType, other: T.DataType) -> T.DataType | None:
    """The one of two types that holds all values of both, if one does."""
    if _keeps_values(one, other) and not isinstance(other, T.StringType):
        return other
    return one if _keeps_values(other, one) and not isinstance(one, T.StringType) else None


def union_schema(have: T.DataType, new: T.DataType) -> T.DataType:
    """A type with all nested fields of both, by name, in which every value stored as the first can be read.

    New fields come last. Where both have a field its type stays, unless the new one is wider in a way that stored
    files can be read in; any whole number counts as ``bigint`` in what is inferred from text, so this alone widens nothing.
    """
    if isinstance(have, T.StructType) and isinstance(new, T.StructType):
        given = {f.name.lower(): f for f in new.fields}
        known = {f.name.lower() for f in have.fields}
        kept = [
            T.StructField(f.name, union_schema(f.dataType, given[f.name.lower()].dataType) if f.name.lower() in given else f.dataType)
            for f in have.fields
        ]
        added = [T.StructField(f.name, nullable(f.dataType)) for f in new.fields if f.name.lower() not in known]
        return T.StructType(kept + added)
    if isinstance(have, T.ArrayType) and isinstance(new, T.ArrayType):
        return T.ArrayType(union_schema(have.elementType, new.elementType))
    if isinstance(have, T.MapType) and isinstance(new, T.MapType):
        return T.MapType(have.keyType, union_schema(have.valueType, new.valueType))
    widened = [(T.IntegerType, T.DoubleType), (T.ShortType, T.DoubleType), (T.ByteType, T.DoubleType), (T.FloatType, T.DoubleType)]
    return new if (type(have), type(new)) in widened else have


def conform(column: Column, have: T.DataType, want: T.DataType) -> Column:
    """Store a column as a type, matching struct fields by name instead of by position."""
    if nullable(have) == nullable(want):
        return column
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        given = {f.name: f.dataType for f in have.fields}
        missing = [f.name for f in want.fields if f.name not in given]
        if missing:
            raise ValueError(f"nested fields missing from source: {missing}")
        fields = [
            conform(column.getField(f.name), given[f.name], f.dataType).alias(f.name)
            for f in want.fields
        ]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return F.transform(column, lambda x: conform(x, have.elementType, want.elementType))
    if isinstance(have, T.MapType) and isinstance(want, T.MapType):
        return column.cast(want)
    return assigned(column, have, want)
