"""Overlaps of fixes by kinds.

What two fixes share depends only on the hashes that other fixes hold too. A fix's kind is those hashes and
the number of all its hashes: fixes of one kind overlap the same others by the same counts. So overlaps are
found between kinds, where thousands of small fixes around one common hunk are one row; counts and best
matches follow by aggregates, and pairs of fixes are listed only where they are asked for.

The shared-hunk join is an equi-join on the hash with a count behind it. With a least overlap t, two
sets can only match if the smaller one shares ``ceil(t * n)`` hashes, so of the m hashes that others hold
too it shares one of the ``m - ceil(t * n) + 1`` rarest. Only those are joined, with a place in the larger set
that leaves enough hashes behind it; pairs that met are compared by their lists, one row for each pair.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from gritsieve.scratch import Scratch

MIN_OVERLAP = 0.5


def _rarity(*sides: DataFrame) -> DataFrame:
    """(hash, df) of the hashes that several sets hold."""
    every = sides[0].select("hash")
    for side in sides[1:]:
        every = every.unionByName(side.select("hash"))
    return every.groupBy("hash").agg(F.count("*").alias("df")).where("df > 1")


def _ordered(rows: DataFrame, key: str, rarity: DataFrame, least: float) -> DataFrame:
    """(key, n, needed, held, common): a set's hashes that others hold too, the rarest first, and how many of them a set as large must share."""
    rare = F.array_sort(F.collect_list(F.struct("df", "hash")))
    sets = rows.join(rarity, "hash").groupBy(key).agg(F.first("n").alias("n"), F.transform(rare, lambda x: x["hash"]).alias("common"))
    return sets.select(key, "n", F.greatest(F.ceil(F.lit(least) * F.col("n") - 1e-9), F.lit(1)).alias("needed"), F.size("common").alias("held"), "common")


def _candidates(small: DataFrame, large: DataFrame, small_key: str, large_key: str, fits: str) -> DataFrame:
    """Pairs that hold one of the rarest hashes of the smaller set, with as many behind it in the larger one as it takes; ``fits`` compares their sizes na and nb."""
    a = small.select(small_key, F.col("n").alias("na"), "needed", "held", F.posexplode("common").alias("at", "hash")).where("at <= held - needed").drop("held", "at")
    b = large.select(large_key, F.col("n").alias("nb"), "held", F.posexplode("common").alias("at", "hash")).select(large_key, "nb", "hash", (F.col("held") - F.col("at")).alias("rest"))
    return a.join(b, "hash").where(f"rest >= needed and ({fits})").select(small_key, large_key)


def _compared(pairs: DataFrame, left: DataFrame, right: DataFrame, least: float, left_key: str, right_key: str) -> DataFrame:
    a, b = left.select(left_key, F.col("n").alias("na"), F.col("common").alias("of_a")), right.select(right_key, F.col("n").alias("nb"), F.col("common").alias("of_b"))
    shared, smaller = F.size(F.array_intersect("of_a", "of_b")), F.least("na", "nb").cast("int")
    met = pairs.distinct().join(a, left_key).join(b, right_key).select(left_key, right_key, shared.alias("shared"), smaller.alias("smaller"))
    return met.where(F.col("shared") / F.col("smaller") >= least)


def shared_hunks(left: DataFrame, right: DataFrame, least: float = MIN_OVERLAP, left_key: str = "ord", right_key: str = "id") -> DataFrame:
    """(left, right, shared, smaller) of the pairs that share ``least`` of the smaller set, or more.

    Both sides are rows (key, n, hash) of distinct hashes.
    """
    rarity = _rarity(left, right)
    a, b = _ordered(left, left_key, rarity, least), _ordered(right, right_key, rarity, least)
    pairs = _candidates(a, b, left_key, right_key, "na <= nb").unionByName(_candidates(b, a, right_key, left_key, "na < nb"))
    return _compared(pairs, a, b, least, left_key, right_key)


def _within(sets: DataFrame, least: float) -> DataFrame:
    """(kind, other, shared, smaller) of the pairs among the ordered sets, each found once and told both ways; a set meets itself too."""
    right = sets.withColumnRenamed("kind", "other")
    pairs = _candidates(sets, right, "kind", "other", "na < nb or (na = nb and kind <= other)")
    met = _compared(pairs, sets, right, least, "kind", "other")
    back = F.when(F.col("kind") != F.col("other"), F.struct(F.col("other").alias("kind"), F.col("kind").alias("other")))
    ways = F.array_compact(F.array(F.struct("kind", "other"), back))
    return met.select("shared", "smaller", F.inline(ways)).select("kind", "other", "shared", "smaller")


class Kinds(NamedTuple):
    """``members`` (patch, kind), without fixes that share nothing; ``pairs`` (kind, other, shared, smaller), both ways and with themselves."""

    members: DataFrame
    pairs: DataFrame


def kinds_of(sets: DataFrame, least: float, scratch: Scratch) -> Kinds:
    """Kinds of the rows (patch, n, hash), in which every fix comes once."""
    common = sets.groupBy("hash").agg(F.count("*").alias("df")).where("df > 1").select("hash")
    held = sets.join(common, "hash").groupBy("patch").agg(F.first("n").alias("n"), F.array_sort(F.collect_list("hash")).alias("common"))
    rows = scratch.stash(held.withColumn("kind", F.md5(F.concat_ws(",", F.col("n").cast("string"), "common"))), "members")
    hashes = scratch.stash(rows.groupBy("kind").agg(F.first("n").alias("n"), F.first("common").alias("common")).select("kind", "n", F.explode("common").alias("hash")), "hashes")
    # a hash that one kind holds is kept: its fixes share it among themselves
    rarity = hashes.groupBy("hash").agg(F.count("*").alias("df"))
    sets = scratch.stash(_ordered(hashes, "kind", rarity, least), "kinds")
    return Kinds(rows.select("patch", "kind"), scratch.stash(_within(sets, least), "pairs"))


def leaders(rows: DataFrame, key: str) -> DataFrame:
    """Of rows (key, m), where ``m`` is in the order of matches: the first two, the first one with a repository, and the first of another repository than that."""
    named = F.when(F.col("m.repo").isNotNull(), F.col("m"))
    ahead = rows.groupBy(key).agg(F.min("m").alias("best"), F.min(named).alias("named"))
    second, other = F.when(F.col("m") > F.col("best"), F.col("m")), F.when(F.col("m.repo") != F.col("named.repo"), F.col("m"))
    rest = rows.join(ahead, key).groupBy(key).agg(F.min(second).alias("second"), F.min(other).alias("other_repo"))
    return ahead.join(rest, key)


def near_entries(kinds: Kinds, entries: DataFrame, scratch: Scratch) -> DataFrame:
    """For each kind the entries that overlap it: how many (``near``), its leaders, and whether its own fixes are among them (``loop``).

    ``entries`` are rows (patch, entry) of fixes; the entry's first field is its id.
    """
    rows = scratch.stash(entries.join(kinds.members, "patch").select("kind", F.col("entry").alias("m")), "entries")
    front = leaders(rows, "kind").join(rows.groupBy("kind").agg(F.count("*").alias("n")), "kind")
    met = scratch.stash(kinds.pairs.join(front.withColumnRenamed("kind", "other"), "other"), "met")
    told = F.explode(F.array_distinct(F.array_compact(F.array("best", "second", "named", "other_repo"))))
    listed = met.select("kind", "shared", "smaller", told.alias("entry"))
    m = F.struct((-F.col("shared") / F.col("smaller")).alias("less_overlap"), (-F.col("shared")).alias("less_shared"), "entry.id", "entry.repo", "entry", "shared", "smaller")
    counts = met.groupBy("kind").agg(F.sum("n").alias("near"), F.max(F.col("kind") == F.col("other")).alias("loop"))
    return scratch.stash(leaders(listed.select("kind", m.alias("m")), "kind").join(counts, "kind"), "near")


def timelines(kinds: Kinds, held: DataFrame, rows: DataFrame) -> DataFrame:
    """(place, way, at, side, n): the lines on which held rows (side 1) and the rows that ask for what comes before them (side 0) meet.

    A pair of kinds is counted where fewer rows have to go: the held ones come to the kind that asks, or
    its rows to the kind that is held. So a small kind costs its own rows, however large those around it are.
    """
    events = held.groupBy(F.col("kind").alias("other"), F.col("since").alias("at")).agg(F.count("*").alias("n"))
    sized = kinds.pairs.select("kind", "other").join(events.groupBy("other").agg(F.count("*").alias("many")), "other").join(rows.groupBy("kind").agg(F.count("*").alias("asked")), "kind")

    def line(rows: DataFrame, place: str, way: int, side: int, at: str, n: Column | None = None) -> DataFrame:
        return rows.select(F.col(place).alias("place"), F.lit(way).alias("way"), F.col(at).alias("at"), F.lit(side).alias("side"), F.lit(0).cast("long").alias("n") if n is None else n)

    come = sized.where("many <= asked").select("kind", "other").join(events, "other").groupBy("kind", "at").agg(F.sum("n").alias("n"))
    go = sized.where("many > asked").select("kind", "other").join(rows, "kind")
    return line(come, "kind", 0, 1, "at", F.col("n")).unionByName(line(rows, "kind", 0, 0, "ord")).unionByName(line(events, "other", 1, 1, "at", F.col("n"))).unionByName(line(go, "other", 1, 0, "ord"))


def earlier(kinds: Kinds, held: DataFrame, rows: DataFrame) -> DataFrame:
    """(ord, earlier): for each of ``rows`` (ord, kind) how many of ``held`` (kind, since) overlap its kind and come before it."""
    order = Window.partitionBy("place", "way").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    told = timelines(kinds, held, rows).withColumn("earlier", F.sum("n").over(order)).where("side = 0")
    return told.groupBy(F.col("at").alias("ord")).agg(F.sum("earlier").alias("earlier"))


#: Documents or entries in one row of a list of pairs.
LISTED = 1000

#: Pairs that one task makes, as long as there are at most so many tasks for each core.
DEALT, WAVES = 4_000_000, 32


def _lists(side: DataFrame, kinds: Kinds, key: str, name: str, *more: str) -> DataFrame:
    """(kind, part, name): the keys of a kind's rows, in lists of about ``LISTED`` at most; with ``more`` columns, structs."""
    held = side.join(kinds.members, "patch").select("kind", key, *more)
    sizes = held.groupBy("kind").agg(F.count("*").alias("size"))
    part = F.pmod(F.xxhash64(key), _parts("size"))
    return held.join(sizes, "kind").groupBy("kind", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct(key, *more) if more else F.col(key))).alias(name))


def _parts(size: str) -> Column:
    return F.ceil(F.col(size) / LISTED).cast("long")


def _sized(kinds: Kinds, lefts: DataFrame, rights: DataFrame) -> DataFrame:
    """(kind, other, shared, smaller, asking, held) of the pairs of kinds with rows on both sides."""
    sizes = lambda lists, key, name, size: lists.groupBy(F.col("kind").alias(key)).agg(F.sum(F.size(name)).alias(size))
    met = kinds.pairs.join(sizes(lefts, "kind", "left", "asking"), "kind").join(sizes(rights, "other", "right", "held"), "other")
    return met.select("kind", "other", "shared", "smaller", "asking", "held")


def meetings(kinds: Kinds, lefts: DataFrame, rights: DataFrame, sized: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kind, other, shared, smaller, asking, held, left) and the same with ``right`` of the pairs of different kinds, dealt by which side is smaller.

    The lists of the smaller side of a pair move to the larger one, whose lists stay: a kind of many rows is not sent to each small kind around it.
    """
    apart = (_sized(kinds, lefts, rights) if sized is None else sized).where("kind <> other")
    go, come = apart.where("asking <= held"), apart.where("asking > held")
    return go.join(lefts.drop("part"), "kind"), come.join(rights.withColumnRenamed("kind", "other").drop("part"), "other")


def _gathered(moved: DataFrame, place: str, size: str, name: str) -> DataFrame:
    """(place, size, shared, smaller, name): what comes to a kind with the same counts, from however many kinds, in lists of about ``LISTED``."""
    group = [place, size, "shared", "smaller"]
    sizes = moved.groupBy(group).agg(F.sum(F.size(name)).alias("coming"))
    part = F.pmod(F.xxhash64(name), _parts("coming"))
    return moved.join(sizes, group).groupBy(*group, part.alias("part")).agg(F.sort_array(F.flatten(F.collect_list(name))).alias(name)).drop("part")


def _met(moved: DataFrame, lists: DataFrame, size: str, key: str) -> DataFrame:
    """(shared, smaller, left, right): moved lists beside each list of the kind that they go to, which is spread by its lists."""
    place = F.explode(F.sequence(F.lit(0).cast("long"), _parts(size) - 1)).alias("part")
    return moved.select("*", place).join(lists.withColumnRenamed("kind", key), [key, "part"]).select("shared", "smaller", "left", "right")


def _dealt(lists: DataFrame, pairs: int) -> DataFrame:
    """Pairs of lists in tasks by the number of pairs that they stand for; by their bytes, which are few, they would be one or two."""
    cores = lists.sparkSession.sparkContext.defaultParallelism
    return lists.repartition(max(1, min(-(-pairs // DEALT), WAVES * cores)))


def pairs_of(kinds: Kinds, rows: DataFrame, entries: DataFrame) -> DataFrame:
    """(ord, id, shared, smaller) of all pairs of ``rows`` (ord, patch) and ``entries`` (id, patch) of different fixes; each fix has one entry at most.

    Rows and entries travel as lists of numbers, and the pairs are made behind the last shuffle. Fixes are
    compared within a kind only: fixes of different kinds differ.
    """
    scratch = Scratch(rows.sparkSession, "pairs")
    own = scratch.stash(_lists(rows.join(entries.select("patch", F.col("id").alias("own")), "patch", "left"), kinds, "ord", "left", "own"), "lefts")
    lefts, rights = own.withColumn("left", F.col("left.ord")), scratch.stash(_lists(entries, kinds, "id", "right"), "rights")
    sized = scratch.stash(_sized(kinds, lefts, rights), "sized")
    pairs = dict(sized.groupBy(F.col("kind") == F.col("other")).agg(F.sum(F.col("asking") * F.col("held"))).collect())
    go, come = meetings(kinds, lefts, rights, sized)
    met = _met(_gathered(go, "other", "held", "left"), rights, "held", "other").unionByName(_met(_gathered(come, "kind", "asking", "right"), lefts, "asking", "kind"))
    inside = _met(sized.where("kind = other").join(own.drop("part"), "kind"), rights, "held", "kind")
    # Spark holds what one row explodes to in one stage of code: the union ends it, so that is a list, not the pairs of two lists
    apart = _dealt(met, pairs.get(False, 0)).select("shared", "smaller", "right", F.explode("left").alias("ord")).withColumn("own", F.lit(None).cast(entries.schema["id"].dataType))
    inside = _dealt(inside, pairs.get(True, 0)).select("shared", "smaller", "right", F.explode("left").alias("a")).select("shared", "smaller", "right", "a.ord", "a.own")
    told = apart.unionByName(inside).select("ord", "own", F.explode("right").alias("id"), "shared", "smaller")
    return told.where("own is null or own <> id").drop("own")
