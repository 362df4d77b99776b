"""MERGE (update all when matched, insert all when not) as joins over DataFrames.

The target is aliased ``t`` and the source ``s``. Spark broadcasts a side when its known size is
under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise, with AQE splitting a hot key
on the target side. A broadcast is asked for only where the caller has measured the source.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestrata.functions.columns import (
    any_null,
    as_list,
    conform,
    fresh,
    quoted,
    row_digest,
    row_identity,
    wider,
)
from lakestrata.operators.interval import Bounds, NoAxis, overlap_join
from lakestrata.operators.shape import duplicate_keys

LAST_BATCH_WINS = "last_batch_wins"
NEWEST_WINS = "newest_wins"


class AmbiguousMerge(ValueError):
    """One target row is matched by several source rows."""


class UnboundedMerge(ValueError):
    """A condition that bounds no side by the other would compare all pairs of rows."""


# More alternatives than that, once ORs are moved out of ANDs, are refused.
MOST_ALTERNATIVES = 32


@dataclass(frozen=True)
class Alternative:
    """One of the cases a condition allows, without any OR at its top."""

    text: str
    joins: bool
    """Whether some expression of ``t`` must equal one of ``s``."""
    equal: list[tuple[str, str]] | None
    """Expressions of ``t`` and ``s`` that must be equal, if it says nothing else."""
    bounds: Bounds | None
    """Intervals of both sides that must overlap."""


@dataclass(frozen=True)
class Condition:
    """What a merge condition asks for, read from Spark's own parse of it."""

    keys: list[str]
    """Columns that must be equal under one name on both sides."""
    joins: bool
    """Whether some expression of ``t`` must equal one of ``s``."""
    plain: bool
    """Whether it says nothing but that keys are equal."""
    used: set[str] | None
    """Columns of ``t`` it mentions; None where a name is not qualified."""
    alternatives: list[Alternative]
    """Cases of which one must hold."""


def _references(node) -> list[list[str]]:
    if node.nodeName() == "UnresolvedAttribute":
        parts = node.nameParts()
        return [[parts.apply(i) for i in range(parts.size())]]
    children = node.children()
    return [r for i in range(children.size()) for r in _references(children.apply(i))]


def _side(node) -> str | None:
    """``t`` or ``s`` for an expression of that side alone."""
    names = {r[0].lower() if len(r) > 1 else None for r in _references(node)}
    return names.pop() if names in ({"t"}, {"s"}) else None


def _cases(node) -> list[list]:
    """The condition as cases, each a list of what must hold, with ORs moved out of ANDs."""
    if node.nodeName() == "Or":
        found = _cases(node.left()) + _cases(node.right())
    elif node.nodeName() == "And":
        found = [a + b for a, b in product(_cases(node.left()), _cases(node.right()))]
    else:
        found = [[node]]
    if len(found) > MOST_ALTERNATIVES:
        raise UnboundedMerge(f"the merge condition has more than {MOST_ALTERNATIVES} alternatives")
    return found


def _orders(node) -> list[tuple]:
    """What a comparison says, as pairs (smaller, greater)."""
    kind, children = node.nodeName(), node.children()
    if kind in ("LessThan", "LessThanOrEqual"):
        return [(node.left(), node.right())]
    if kind in ("GreaterThan", "GreaterThanOrEqual"):
        return [(node.right(), node.left())]
    if kind == "UnresolvedFunction" and children.size() == 3 and node.nameParts().mkString(".").lower() == "between":
        value, low, high = (children.apply(i) for i in range(3))
        return [(low, value), (value, high)]
    return []


def _bounds(case: list) -> Bounds | None:
    """The intervals that comparisons make of a side's expressions, preferably of one compared both ways."""
    ordered = [(_side(a), a.sql(), _side(b), b.sql()) for node in case for a, b in _orders(node)]
    starts = [(low, high) for x, low, y, high in ordered if (x, y) == ("t", "s")]  # of t, and where s ends
    ends = [(high, low) for x, low, y, high in ordered if (x, y) == ("s", "t")]  # of t, and where s starts
    if not starts or not ends:
        return None
    found = [Bounds((t_low, t_high), (s_low, s_high)) for (t_low, s_high), (t_high, s_low) in product(starts, ends)]
    return min(found, key=lambda b: b.t[0] != b.t[1] and b.s[0] != b.s[1])


def _alternative(case: list) -> Alternative:
    equal, joins = [], False
    for node in case:
        if node.nodeName() not in ("EqualTo", "EqualNullSafe"):
            continue
        sides = {_side(x): x.sql() for x in (node.left(), node.right())}
        if sides.keys() == {"t", "s"}:
            joins = True
            if node.nodeName() == "EqualTo":
                equal.append((sides["t"], sides["s"]))
    text = " AND ".join(f"({node.sql()})" for node in case)
    return Alternative(text, joins, equal if len(equal) == len(case) else None, _bounds(case))


def read_condition(condition: str) -> Condition:
    """Take a condition over ``t`` and ``s`` apart at its ANDs, and without an equality at its ORs."""
    parser = SparkSession.active()._jsparkSession.sessionState().sqlParser()
    whole = parser.parseExpression(condition)
    todo, parts = [whole], []
    while todo:
        node = todo.pop()
        if node.nodeName() == "And":
            todo += [node.right(), node.left()]
        else:
            parts.append(node)
    keys, joins = [], False
    for node in parts:
        if node.nodeName() not in ("EqualTo", "EqualNullSafe"):
            continue
        sides = [_references(side) for side in (node.left(), node.right())]
        names = [{r[0].lower() if len(r) > 1 else None for r in side} for side in sides]
        if sorted(map(sorted, (map(str, n) for n in names))) != [["s"], ["t"]]:
            continue
        joins = True
        bare = [side.nodeName() == "UnresolvedAttribute" for side in (node.left(), node.right())]
        (one,), (other,) = sides if all(bare) else ([[]], [[]])
        if node.nodeName() == "EqualTo" and len(one) == len(other) == 2 and one[1].lower() == other[1].lower():
            keys.append(one[1])
    every = [r for node in parts for r in _references(node)]
    used = {r[1].lower() for r in every if len(r) > 1 and r[0].lower() == "t"}
    known = all(len(r) > 1 and r[0].lower() in ("t", "s") for r in every)
    cases = [] if joins else [_alternative(case) for case in _cases(whole)]
    return Condition(keys, joins, len(keys) == len(parts), used if known else None, cases)


def equality_keys(condition: str) -> list[str] | None:
    """Key names when the condition is just ``t.k = s.k [and ...]``, else None."""
    found = read_condition(condition)
    return found.keys if found.plain else None


def align(source: DataFrame, schema: T.StructType) -> DataFrame:
    """Give the source the target's columns and types.

    Columns the target does not have are ignored; a missing one is an error, and so is, when it is
    read, a value that the target's type cannot hold: keys are never wrapped, cut or made NULL. As
    in SQL, names match in any case.
    """
    have = {f.name.lower(): f for f in source.schema.fields}
    missing = [f.name for f in schema.fields if f.name.lower() not in have]
    if missing:
        raise ValueError(f"columns missing from merge source: {missing}")
    pairs = [(have[f.name.lower()], f) for f in schema.fields]
    return source.select(
        *[conform(quoted(s.name), s.dataType, t.dataType).alias(t.name) for s, t in pairs]
    )


def spelled_as(keys: list[str], columns: list[str]) -> list[str]:
    """The keys as the table spells them."""
    names = {c.lower(): c for c in columns}
    return [names.get(k.lower(), k) for k in keys]


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [quoted(k, "t") == quoted(k, "s") for k in keys])


def _split(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with whole keys, and rows with a NULL key.

    The latter match nothing and pass joins by, where they would all meet in one task. Where there
    are none, parquet statistics let the second scan skip every row group.
    """
    return df.filter(~any_null(keys)), df.filter(any_null(keys))


def _anti_keys(df: DataFrame, keys: list[str], found: DataFrame) -> DataFrame:
    """Rows whose key is not among the found ones."""
    whole, partial = _split(df, keys)
    rest = whole.join(found, keys, "left_anti")
    return rest.select(*[quoted(c) for c in df.columns]).unionByName(partial)


def _rank(
    alias: str | None, order_by: list[str], ties: list[str], schema: T.StructType | None = None
) -> Column:
    """Comparable age of a row; NULL counts as oldest. With a schema equal ages go by a row hash."""
    last = [] if schema is None else [row_digest(schema, alias)]
    return F.struct(*[quoted(c, alias) for c in order_by + ties], *last)


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Whole keys that occur more than once."""
    return duplicate_keys(df.select(*keys).dropna(subset=keys), keys).select(*keys)


def check_single_match(target: DataFrame, source: DataFrame, keys: list[str]) -> bool:
    """Raise if a target row has several source rows; tell whether the source keys are unique."""
    repeated = repeated_keys(source, keys)
    if repeated.isEmpty():
        return True
    if not target.select(*keys).join(repeated, keys, "left_semi").isEmpty():
        raise AmbiguousMerge(f"several source rows match one target row on {keys}")
    return False


def merge_unique(
    target: DataFrame,
    source: DataFrame,
    keys: str | list[str],
    newest_by: str | list[str] | None = None,
    tie_breakers: str | list[str] | None = None,
) -> DataFrame:
    """Merge when both sides hold each whole key at most once.

    The last batch wins by one anti join and a union. With ``newest_by`` one full outer join keeps
    the younger row of each pair; equal ages go to the tie-breakers, then to a row hash, so that the
    order of batches does not matter.
    """
    keys = as_list(keys)
    source = align(source, target.schema)
    if newest_by:
        return _newer_rows(target, source, keys, as_list(newest_by), as_list(tie_breakers))
    return kept_rows(target, source, keys).unionByName(source)


def _newer_rows(target, source, keys, order_by, ties) -> DataFrame:
    (stored, stored_partial), (given, given_partial) = _split(target, keys), _split(source, keys)
    younger = _rank("s", order_by, ties, source.schema) >= _rank("t", order_by, ties, target.schema)
    hit = fresh("_hit", target.columns)
    take = quoted(hit, "s").isNotNull() & (quoted(hit, "t").isNull() | younger)
    pairs = stored.withColumn(hit, F.lit(True)).alias("t").join(
        given.withColumn(hit, F.lit(True)).alias("s"), _same(keys), "full_outer"
    )
    chosen = _choose(pairs, take, target.columns)
    return chosen.unionByName(stored_partial).unionByName(given_partial)


def _choose(pairs: DataFrame, take: Column, columns: list[str]) -> DataFrame:
    return pairs.select(
        *[F.when(take, quoted(c, "s")).otherwise(quoted(c, "t")).alias(c) for c in columns]
    )


def kept_rows(target: DataFrame, source: DataFrame, keys: list[str], small: bool = False) -> DataFrame:
    """Target rows that no source row matches. ``small`` says the source keys were measured to fit
    a broadcast, so that the target is not shuffled."""
    given = source.select(*[quoted(k) for k in keys]).dropna(subset=keys)
    return _anti_keys(target, keys, F.broadcast(given) if small else given)


def without_stale(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    order_by: list[str],
    ties: list[str],
    small: bool = False,
) -> DataFrame:
    """Source rows but those older than a target row with their key, read from the target's keys and
    ages alone. Whole target rows are read only for keys of equal age, to compare row hashes."""
    rank = fresh("_rank", target.columns)
    columns = [quoted(k) for k in keys] + [_rank(None, order_by, ties).alias(rank)]
    stored, given = [df.dropna(subset=keys).select(*columns) for df in (target, source)]
    given = F.broadcast(given) if small else given
    same, ages = _same(keys), (quoted(rank, "t"), quoted(rank, "s"))
    older = stored.alias("t").join(given.alias("s"), same & (ages[0] > ages[1]), "left_semi")
    tied = stored.alias("t").join(given.alias("s"), same & (ages[0] == ages[1]), "left_semi")
    tied = F.broadcast(tied.select(*keys)) if small else tied.select(*keys)
    digest = [*[quoted(k) for k in keys], row_digest(source.schema).alias(rank)]
    equal = target.join(tied, keys, "left_semi").select(*digest)
    worse = equal.alias("t").join(source.select(*digest).alias("s"), same & (ages[0] > ages[1]), "left_semi")
    return _anti_keys(source, keys, older.select(*keys).unionByName(worse.select(*keys)))


def merge_all(
    target: DataFrame,
    source: DataFrame,
    on: str | list[str] | None = None,
    condition: str | None = None,
    newest_by: str | list[str] | None = None,
    tie_breakers: str | list[str] | None = None,
    check: bool = True,
    all_pairs: bool = False,
    widen: bool = False,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """General merge on key columns or on a condition over ``t`` and ``s``.

    Keeps every target row (also repeated and NULL keys) and raises :class:`AmbiguousMerge` when a
    target row has several matches. A condition may equate expressions of the two sides, or bound them from
    both sides (intervals that overlap, values in an interval), or be alternatives that each do; any other is refused
    unless ``all_pairs`` accepts that every row meets every other. ``widen`` gives target columns the
    source's type where that holds all values of both. ``keep`` may persist the joined pairs, which
    are otherwise worked out for the check, the update and the insert.
    """
    if (on is None) == (condition is None):
        raise ValueError("give either on or condition")
    target = _widened(target, source) if widen else target
    source, columns = align(source, target.schema), target.columns
    found = read_condition(condition) if condition else None
    keys = spelled_as(as_list(on) or (found.keys if found.plain else []), columns)
    hit = fresh("_hit", columns)
    take = F.coalesce(quoted(hit, "s"), F.lit(False))
    if newest_by:
        ages = [_rank(side, as_list(newest_by), as_list(tie_breakers), source.schema) for side in "st"]
        take = take & (ages[0] >= ages[1])
    hits = source.withColumn(hit, F.lit(True))

    if keys:
        if check:
            check_single_match(target, source, keys)
        whole, partial = _split(target, keys)
        pairs = whole.alias("t").join(hits.alias("s"), _same(keys), "left")
        inserted = _anti_keys(source, keys, _matched_keys(target, source, keys))
        return _choose(pairs, take, columns).unionByName(partial).unionByName(inserted)

    if not found.joins and all(a.joins or a.bounds for a in found.alternatives):
        try:
            return _merge_by_cases(target, source, found, take, hit, check, keep)
        except NoAxis as error:
            if not all_pairs:
                raise UnboundedMerge(str(error)) from error
    if not found.joins and not all_pairs:
        raise UnboundedMerge("the merge condition neither equates nor bounds t and s; add that or accept all_pairs")
    # rows are told apart by two hashes, so a hot target key shrinks to its source rows before they
    # are sought among all of them
    row, one, two = (fresh(n, columns) for n in ("_row", "_one", "_two"))
    hits = hits.withColumns(row_identity(source.schema, [one, two]))
    numbered = target.withColumn(row, F.monotonically_increasing_id())
    pairs = numbered.alias("t").join(hits.alias("s"), F.expr(condition), "left").select(
        F.struct(*[quoted(c, "t") for c in columns]).alias("t"),
        F.struct(*[quoted(c, "s") for c in [*columns, hit]]).alias("s"),
        quoted(row, "t"),
        quoted(one, "s"),
        quoted(two, "s"),
    )
    pairs = keep(pairs) if keep else pairs
    if check:
        matches = pairs.filter(quoted(one).isNotNull()).groupBy(quoted(row)).count()
        if not matches.filter("count > 1").isEmpty():
            raise AmbiguousMerge("several source rows match one target row")
    matched = pairs.filter(quoted(one).isNotNull()).select(quoted(one), quoted(two)).distinct()
    inserted = hits.join(matched, [one, two], "left_anti").select(*[quoted(c) for c in columns])
    return _choose(pairs, take, columns).unionByName(inserted)


def _merge_by_cases(
    target: DataFrame,
    source: DataFrame,
    found: Condition,
    take: Column,
    hit: str,
    check: bool,
    keep: Callable[[DataFrame], DataFrame] | None,
) -> DataFrame:
    """Merge on alternatives that are joined one by one, by equal keys or by bins of overlapping intervals.

    Rows are told apart by two hashes of their content: equal target rows match the same source rows, equal source
    rows count as several. A pair that several alternatives find is one.
    """
    columns = target.columns
    t_row, s_row = ([fresh(f"{n}{i}", columns) for i in (1, 2)] for n in ("_t", "_s"))
    copies, row = fresh("_copies", columns), fresh("_row", columns)
    marked = target.withColumns(row_identity(target.schema, t_row))
    hits = source.withColumns(row_identity(source.schema, s_row))
    used = [c for c in columns if found.used is None or c.lower() in found.used]
    stored = marked.select(*[quoted(c) for c in used], *t_row).dropDuplicates(t_row)
    whole = F.struct(*[quoted(c) for c in columns], F.lit(True).alias(hit))
    counted = hits.groupBy(*s_row).agg(F.any_value(whole).alias(row), F.count("*").alias(copies))
    given = counted.select(F.col(f"{row}.*"), *s_row, copies)
    found_pairs = [_case_pairs(stored, given, case, t_row, s_row, copies, check) for case in found.alternatives]
    pairs = reduce(DataFrame.unionByName, found_pairs)
    pairs = pairs.dropDuplicates(t_row + s_row) if len(found_pairs) > 1 else pairs
    pairs = keep(pairs) if keep else pairs
    if check:
        matches = pairs.groupBy(*t_row).agg(F.sum(copies).alias(copies))
        if not matches.filter(quoted(copies) > 1).isEmpty():
            raise AmbiguousMerge("several source rows match one target row")
    inserted = hits.join(pairs.select(*s_row).distinct(), s_row, "left_anti").select(*[quoted(c) for c in columns])
    matched = pairs.drop(copies).join(counted.select(*s_row, row), s_row).select(*t_row, quoted(row).alias("s"))
    old = F.struct(*[quoted(c) for c in columns]).alias("t")
    both = marked.select(old, *t_row).join(matched, t_row, "left")
    return _choose(both, take, columns).unionByName(inserted)


def _case_pairs(stored, given, case: Alternative, t_row, s_row, copies, check) -> DataFrame:
    """Hashes of the rows that one alternative matches."""
    if check and case.equal:
        # keys that many rows of both sides share are found out before they are joined
        keys = [F.expr(s).alias(f"_k{i}") for i, (_, s) in enumerate(case.equal)]
        counts = given.alias("s").groupBy(*keys).agg(F.sum(quoted(copies)).alias("_n"))
        names = [f"_k{i}" for i in range(len(keys))]
        several = counts.filter("_n > 1").dropna(subset=names).select(*names)
        asked = stored.alias("t").select(*[F.expr(t).alias(n) for n, (t, _) in zip(names, case.equal, strict=True)])
        if not several.isEmpty() and not asked.join(several, names, "left_semi").isEmpty():
            raise AmbiguousMerge("several source rows match one target row")
    wanted = [quoted(c, "t") for c in t_row] + [quoted(c, "s") for c in [*s_row, copies]]
    if case.joins:
        return stored.alias("t").join(given.alias("s"), F.expr(case.text)).select(*wanted)
    return overlap_join(stored, given, case.bounds, case.text).select(*wanted)


def _widened(target: DataFrame, source: DataFrame) -> DataFrame:
    given = {f.name.lower(): f.dataType for f in source.schema.fields}
    kinds = {f.name: wider(f.dataType, given.get(f.name.lower(), f.dataType)) for f in target.schema.fields}
    return target.select(
        *[quoted(f.name).cast(kinds[f.name] or f.dataType).alias(f.name) for f in target.schema.fields]
    )


def _matched_keys(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    stored, given = [df.select(*keys).dropna(subset=keys) for df in (target, source)]
    return stored.join(given, keys, "left_semi").distinct()
