"""Counts over outcomes: funnels, bands, reasons, collisions and feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gritsieve.operators.places import placed
from gritsieve.schema import BANDS, OUTCOMES, REASONS, STATUSES


def ordinal(value: Column, names: Sequence[str]) -> Column:
    """The place of a name in a fixed order; unknown names come last."""
    known = F.create_map(*[F.lit(x) for pair in zip(names, range(len(names))) for x in pair])
    return F.coalesce(F.try_element_at(known, value), F.lit(len(names)))


def reason_counts(outcomes: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """(keys, reason, n, ord) of rejected rows, without zeros."""
    return outcomes.where("reason is not null").groupBy(*keys, "reason").agg(F.count("*").alias("n")).withColumn("ord", ordinal(F.col("reason"), list(REASONS)))


def band_counts(outcomes: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    return outcomes.where("band is not null").groupBy(*keys, "band").agg(F.count("*").alias("n")).withColumn("ord", ordinal(F.col("band"), BANDS))


def funnel(outcomes: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """(keys, step, n, remaining, ord): all rows, then each reason in order with what is left behind it."""
    walked = outcomes.groupBy(*keys).agg(F.count("*").alias("walked"))
    steps = reason_counts(outcomes, keys).join(walked, list(keys))
    gone = F.sum("n").over(Window.partitionBy(*keys).orderBy("ord", "reason").rowsBetween(Window.unboundedPreceding, 0))
    rest = steps.select(*keys, F.col("reason").alias("step"), "n", (F.col("walked") - gone).alias("remaining"), (F.col("ord") + 1).alias("ord"))
    return walked.select(*keys, F.lit("walked").alias("step"), F.col("walked").alias("n"), F.col("walked").alias("remaining"), F.lit(0).alias("ord")).unionByName(rest)


def pivoted(rows: DataFrame, keys: Sequence[str], column: str, names: Sequence[str]) -> DataFrame:
    """One column for each name with its count, zeros kept: conditional counts in one aggregate."""
    return rows.groupBy(*keys).agg(*[F.count_if(F.col(column) == n).cast("long").alias(n) for n in names])


def outcome_counts(judged: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    return pivoted(judged, keys, "outcome", OUTCOMES)


def status_counts(judged: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    return pivoted(judged, keys, "status", STATUSES)


def feature_table(outcomes: DataFrame, keys: Sequence[str], names: Sequence[str], features: str = "score_features") -> DataFrame:
    """One column for each feature with its contribution: map lookups, no pivot and no shuffle."""
    held = F.map_from_entries(F.transform(F.col(features), lambda f: F.struct(f["name"], f["contribution"])))
    return outcomes.where(F.col(features).isNotNull()).withColumn("__held", held).select(*keys, *[F.try_element_at(F.col("__held"), F.lit(n)).alias(n) for n in names])


#: Shas in one row of ``rejected_lists``.
LISTED = 10_000


def rejected_lists(outcomes: DataFrame, keys: Sequence[str] = ("repo",), most: int = LISTED) -> DataFrame:
    """The rejected shas of each reason, in walk order, in parts of ``most`` shas: a reason of any size fits its rows."""
    groups = [*keys, "reason"]
    rows = placed(outcomes.where("reason is not null").select(*groups, "pos", "sha"), groups, [F.col("pos"), F.col("sha")], "place")
    parts = rows.groupBy(*groups, F.floor((F.col("place") - 1) / most).cast("int").alias("part")).agg(F.sort_array(F.collect_list(F.struct("pos", "sha"))).alias("rows"))
    return parts.select(*groups, "part", F.transform("rows", lambda r: r["sha"]).alias("shas"), ordinal(F.col("reason"), list(REASONS)).alias("ord"))


def collision_counts(collisions: DataFrame) -> DataFrame:
    """(repo, other, n, same_commit, same_fix, overlaps) over collision rows."""
    return collisions.groupBy("repo", "other").agg(
        F.count("*").alias("n"), F.count_if("same_commit").alias("same_commits"),
        F.count_if(~F.col("same_commit") & (F.col("status") == "duplicate")).alias("same_fixes"), F.count_if(F.col("status") == "overlap").alias("overlaps"),
    )
