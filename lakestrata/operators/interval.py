"""Joins on overlapping intervals, as equi-joins on bins.

Each side has an interval per row (a point is one that starts where it ends). Bounds become whole numbers that rise
with them, and these are cut into bins, eight of one level making one of the next. A row is at home on the level where
its interval covers 8 to 64 bins, or on the finest. It meets the rows of its own and finer levels in the bins of its
home, and in the bins of coarser levels it meets the rows at home there: a long interval becomes a bounded number of
rows, and a point one for each level that the other side uses. So what is compared beyond the true pairs lies in the two
outer bins of an interval, however values are spread. A pair that shares several bins meets in the first. Bins that
hold too much for one task are split by hash.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestrata.functions.columns import fresh, quoted, row_digest

#: Rows of one side that one task compares in a bin; more where more than 1024 times as many are joined.
ROWS_PER_TASK = 200_000
SPLITS = 1024


class NoAxis(ValueError):
    """Bounds of types that have no common axis."""


@dataclass(frozen=True)
class Bounds:
    """SQL expressions of the least and greatest value of a row's interval; one of ``t``, the other of ``s``."""

    t: tuple[str, str]
    s: tuple[str, str]


#: As far as numbers are placed from 0; what lies beyond, infinity too, has the same place.
FARTHEST = float(1 << 60)
AXES = ("whole", "number", "date", "timestamp", "local time")


def _kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return "whole" if isinstance(data_type, T.IntegralType) else "number"
    kinds = {T.DateType: "date", T.TimestampType: "timestamp", T.TimestampNTZType: "local time"}
    return kinds.get(type(data_type), data_type.simpleString())


def _axis(types: list[T.DataType]) -> str:
    """What the bounds are measured in: Spark compares dates with times as the midnight they start at."""
    kinds = {_kind(t) for t in types}
    axis = "number" if kinds == {"whole", "number"} else max(kinds - {"date"} or kinds)
    if len(kinds - {"date", axis}) and axis != "number" or axis not in AXES:
        raise NoAxis(f"no common axis of {[t.simpleString() for t in types]}")
    return axis


def _measured(value: Column, axis: str) -> Column:
    """A whole number of at most 63 bits that never falls where the value rises; NULL for NULL."""
    if axis == "whole":
        return F.shiftright(value.cast("bigint"), 1)
    if axis == "date":
        return F.unix_date(value).cast("bigint")
    if axis == "timestamp":
        return F.shiftright(F.unix_micros(value.cast("timestamp")), 1)
    if axis == "local time":
        local = value.cast("timestamp_ntz")
        day = F.unix_date(local.cast("date")).cast("bigint")
        return day * 86400 + F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    # the logarithm spaces numbers of any size, and like Spark's order takes NaN for the greatest
    number = value.cast("double")
    scaled = F.signum(number) * F.log1p(F.abs(number)) * float(1 << 50)
    scaled = F.when(F.isnan(number), FARTHEST).otherwise(F.greatest(F.least(scaled, F.lit(FARTHEST)), F.lit(-FARTHEST)))
    return F.floor(scaled).cast("bigint")


def _at(number: Column, level: Column) -> Column:
    """The bin of a level that a number lies in."""
    return F.call_function("shiftright", number, (level * 3).cast("int"))


def _keys(names: tuple[str, str, str], at_home: list[int], above: list[int], kind: int) -> Column:
    """The (level, bin, kind, first) that a row meets others in; ``first`` is its first bin of that level.

    A row that is at home on one of the levels ``at_home`` meets there, with its own kind, what the other side has at this
    and finer levels; at the levels ``above``, where rows of the other side are at home, it meets these with theirs. Rows of
    equal levels meet with the kind of ``t``, 1.
    """
    first, last, level = map(quoted, names)

    def bins(n: Column, of: int) -> Column:
        def key(b: Column) -> Column:
            fields = {"level": n, "bin": b, "kind": F.lit(of), "first": _at(first, n)}
            return F.struct(*[c.alias(name) for name, c in fields.items()])

        return F.transform(F.sequence(_at(first, n), _at(last, n)), key)

    def levels(numbers: list[int]) -> Column:
        return F.array(*map(F.lit, numbers)).cast("array<int>")

    own = F.filter(levels(at_home), lambda n: n == level)
    others = F.filter(levels(above), lambda n: n >= level if kind == 2 else n > level)
    met = F.concat(F.transform(own, lambda n: bins(n, kind)), F.transform(others, lambda n: bins(n, 3 - kind)))
    return F.flatten(met)


def _large(binned: dict[str, DataFrame], key: str, most: int) -> DataFrame:
    """Bins with more rows of a side than a task should hold, and the number of parts of each side."""
    counts = [b.select(quoted(key).dropFields("first").alias("key"), F.lit(n).alias("of")) for n, b in binned.items()]
    sizes = reduce(DataFrame.unionByName, counts).groupBy("key").pivot("of", list(binned)).count().na.fill(0)
    large = sizes.filter(reduce(lambda a, b: a | b, [F.col(n) > most for n in binned]))
    parts = [F.greatest(F.ceil(F.col(n) / F.lit(most)), F.lit(1)).cast("int").alias(n) for n in binned]
    return large.select("key", *parts)


def _dealt(rows: DataFrame, large: DataFrame | None, at: list[str], own: str, other: str) -> DataFrame:
    """Rows by bin; of a large bin each goes to one part of its own side and to every part of the other."""
    key, i, j = at
    if large is None:
        return rows.withColumns({i: F.lit(0), j: F.lit(0)})
    names = [fresh(n, rows.columns) for n in ("_bin", "_own", "_other")]
    sizes = large.select(*[F.col(c).alias(n) for c, n in zip(("key", own, other), names, strict=True)])
    known = rows.join(F.broadcast(sizes), quoted(key).dropFields("first") == quoted(names[0]), "left")
    parts, others = (F.coalesce(quoted(n), F.lit(1)) for n in names[1:])
    turn = F.pmod(row_digest(rows.drop(key).schema, seed=3), parts)
    out = known.withColumn(i, turn.cast("int")).withColumn(j, F.explode(F.sequence(F.lit(0), others - 1)))
    return out.drop(*names)


def overlap_join(t: DataFrame, s: DataFrame, bounds: Bounds, condition: str) -> DataFrame:
    """Pairs (``t``, ``s``) of whole rows for which a condition holds that no two rows meet whose intervals lie apart.

    An interval that ends before it starts is taken the other way round: the condition holds for such a row only
    where the other row's interval covers both ends. NULL bounds match nothing, an empty table joins nothing.
    """
    frames = {"t": t, "s": s}
    ends = {n: [F.expr(e) for e in getattr(bounds, n)] for n in frames}
    axis = _axis([f.dataType for n, df in frames.items() for f in df.alias(n).select(*ends[n]).schema.fields])
    names = [fresh(n, t.columns, s.columns) for n in ("_first", "_last", "_level", "_key", "_i", "_j")]
    first, last, level, *at = names
    measured = {}
    for n, df in frames.items():
        one, two = (_measured(e, axis) for e in ends[n])
        # least and greatest pass over NULLs, so ask for both ends
        known = df.alias(n).filter(one.isNotNull() & two.isNotNull())
        measured[n] = known.select(f"{n}.*", F.least(one, two).alias(first), F.greatest(one, two).alias(last))

    placed = {}
    for n, df in measured.items():
        length = quoted(last) - quoted(first)
        home = F.when(length < 64, 0).otherwise(F.floor(F.log2(length) / 3 - 1).cast("int"))
        placed[n] = df.withColumn(level, home)
    levels = [df.groupBy(F.lit(n).alias("of"), F.col(level).alias("level")).count() for n, df in placed.items()]
    counts = reduce(DataFrame.unionByName, levels).collect()  # at most one row for each side and level
    homes = {n: sorted(r.level for r in counts if r.of == n) for n in frames}
    total = sum(r["count"] for r in counts)
    # rows of t meet at home what s has there or at finer levels, rows of s what t has at finer ones
    met_t = [n for n in homes["t"] if any(m <= n for m in homes["s"])]
    met_s = [n for n in homes["s"] if any(m < n for m in homes["t"])]
    where = (first, last, level)
    keys = {"t": _keys(where, met_t, met_s, 1), "s": _keys(where, met_s, met_t, 2)}
    key = at[0]
    binned = {n: df.withColumn(key, F.explode(keys[n])) for n, df in placed.items()}

    most = max(ROWS_PER_TASK, total // SPLITS)
    large = _large(binned, key, most) if total > most else None
    left = _dealt(binned["t"], large, at, "t", "s")
    right = _dealt(binned["s"], large, [key, at[2], at[1]], "s", "t")
    fields = [(quoted(key, "t").getField(f), quoted(key, "s").getField(f)) for f in ("level", "bin", "kind", "first")]
    same = [a == b for a, b in fields[:3]] + [quoted(c, "t") == quoted(c, "s") for c in at[1:]]
    # of the bins that both rows lie in, the first
    same.append(fields[1][0] == F.greatest(*fields[3]))
    joined = left.alias("t").join(right.alias("s"), reduce(lambda a, b: a & b, same) & F.expr(condition))
    return joined.select(*[F.struct(*[quoted(c, n) for c in df.columns]).alias(n) for n, df in frames.items()])
