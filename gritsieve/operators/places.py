"""Places of rows within groups that may be hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gritsieve.scratch import Scratch


def _free(columns: Sequence[str], *names: str) -> list[str]:
    """Names for helper columns that none of the columns has, whatever the case."""
    held, mark = {c.lower() for c in columns}, "__"
    while any(f"{mark}{n}" in held for n in names):
        mark += "_"
    return [mark + n for n in names]


def placed(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``rows`` with their 1-based place in their group.

    Rows are dealt by ranges of group and order, so a group of any size is spread over tasks. Each range numbers
    its own rows and adds the rows of the same group in the ranges before it: one count for each group and range.
    The rows are written before and after they are dealt, as the ranges are sampled; pass narrow ones.
    """
    scratch, (part, at, before, own_place) = Scratch(rows.sparkSession, "places"), _free([*rows.columns, name], "range", "at", "before", "own")
    own = scratch.stash(rows, "rows")
    dealt = scratch.stash(own.repartitionByRange(*groups, *order).withColumn(part, F.spark_partition_id()), "ranges")
    scratch.drop("rows")
    ahead = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*groups, part).agg(F.count("*").alias("n"))
    starts = counts.select(F.struct(*groups, part).alias(at), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(before))
    within = F.row_number().over(Window.partitionBy(*groups, part).orderBy(*order))
    joined = dealt.withColumn(own_place, within).join(starts, F.struct(*groups, part).eqNullSafe(F.col(at)), "left")
    return joined.withColumn(name, F.col(before) + F.col(own_place)).drop(part, at, before, own_place)
