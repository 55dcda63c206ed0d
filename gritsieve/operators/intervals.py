"""Joins of ranges that overlap: lines in regions, hunks that touch a definition.

A range of at most 2^k lines covers at most two bins of 2^k. Every range takes the least such k as its level and is
dealt to its bins there, and once more to its bins at each higher level that the other side has. Two ranges
meet at the higher of their levels, in the first bin that both cover, so each pair is found once, by an equi-join on
(keys, level, bin). A long range costs two rows for each level and not one for each bin, and a file that holds a
third of all ranges is spread over its bins.

Defined results: ends are inclusive; a range with a null end or key, or whose end is before its start, overlaps
nothing; equal ranges are told apart by their other columns only; empty inputs give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _level(start: Column, end: Column) -> Column:
    """The least k with 2^k >= the length of the range."""
    return F.ceil(F.log2((end - start + 1).cast("double"))).cast("int")


def _levels(*sides: DataFrame) -> list[int]:
    """The levels that occur on any side: 63 at most."""
    found = sides[0].select("__level").distinct()
    for side in sides[1:]:
        found = found.unionByName(side.select("__level").distinct())
    return sorted(r[0] for r in found.distinct().collect())


def _binned(rows: DataFrame, levels: list[int]) -> DataFrame:
    """One row for each bin of the range at its own and at all higher levels."""
    up = F.filter(F.array(*map(F.lit, levels)), lambda k: k >= F.col("__level"))
    spread = rows.select("*", F.explode(up).alias("__at"))
    first, last = F.expr("shiftright(__start, __at)"), F.expr("shiftright(__end, __at)")
    return spread.select("*", first.alias("__first"), F.explode(F.sequence(first, last)).alias("__bin"))


def overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], left_range: tuple[str, str] = ("start", "end"), right_range: tuple[str, str] = ("start", "end")) -> DataFrame:
    """Pairs of rows of equal ``keys`` whose inclusive ranges share a place: the columns of both sides, the keys once.

    Other columns of the two sides need names of their own.
    """
    shared = sorted(({c.lower() for c in left.columns} & {c.lower() for c in right.columns}) - {k.lower() for k in keys})
    if shared or any(c.lower().startswith("__") for c in (*left.columns, *right.columns)):
        raise ValueError(f"columns of both sides, or with reserved names: {shared or [c for c in (*left.columns, *right.columns) if c.startswith('__')]}")

    def side(rows: DataFrame, ends: tuple[str, str]) -> DataFrame:
        start, end = (F.col(c).cast("long") for c in ends)
        return rows.where(start.isNotNull() & end.isNotNull() & (start <= end)).select("*", start.alias("__start"), end.alias("__end"), _level(start, end).alias("__level"))

    a, b = side(left, left_range), side(right, right_range)
    levels = _levels(a, b)
    if not levels:
        levels = [0]
    rename = {c: f"__other{c}" for c in ("__start", "__end", "__level", "__first")}
    met = _binned(a, levels).join(_binned(b, levels).withColumnsRenamed(rename), [*keys, "__at", "__bin"])
    own = (F.col("__at") == F.greatest("__level", "__other__level")) & (F.col("__bin") == F.greatest("__first", "__other__first"))
    touch = (F.col("__start") <= F.col("__other__end")) & (F.col("__other__start") <= F.col("__end"))
    return met.where(own & touch).select(*keys, *[c for c in left.columns if c not in keys], *[c for c in right.columns if c not in keys])


def within(points: DataFrame, regions: DataFrame, keys: Sequence[str], point: str = "line", region: tuple[str, str] = ("start", "end")) -> DataFrame:
    """Pairs of points and the regions that hold them."""
    return overlaps(points, regions, keys, (point, point), region)


def touched(hunks: DataFrame, definitions: DataFrame, keys: Sequence[str], name: str = "name") -> DataFrame:
    """``hunks`` (keys, new_start, n_added) to the names of the definitions (keys, name, start, end) that each file's hunks touch.

    A hunk without added lines touches what holds its start.
    """
    ends = hunks.select(*keys, F.col("new_start").cast("long").alias("from"), (F.col("new_start") + F.greatest(F.col("n_added") - 1, F.lit(0))).cast("long").alias("to"))
    return overlaps(ends, definitions.select(*keys, name, "start", "end"), keys, ("from", "to")).groupBy(*keys).agg(F.array_sort(F.collect_set(name)).alias("names"))
