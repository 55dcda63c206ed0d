"""Connected components by alternating large and small stars.

Every step is a partial aggregate and an equi-join, so a hub with very many neighbours is combined on
the map side and its join partition can be split; no neighbourhood is ever gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gritsieve.scratch import Scratch


def _lowest(pairs: DataFrame) -> DataFrame:
    """(u, m): the smallest of a node and its neighbours in ``pairs`` (u, v)."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    low = _lowest(down)
    return down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, scratch: Scratch, first: str = "a", second: str = "b") -> DataFrame:
    """(node, root) for every node of an edge table of longs; the root is the smallest node reachable.

    Null ends and loops are dropped; repeated edges count once; no edges give no rows. Rounds are
    written to the shared folder, so no lineage grows and none is lost with an executor.
    """
    edges = edges.select(F.col(first).alias("u"), F.col(second).alias("v")).where("u <> v").distinct()
    edges, mark, step = scratch.stash(edges, "star-0"), None, 0
    while True:
        n, total = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n == 0 or (n, total) == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        mark, step = (n, total), step + 1
        stars = _small_star(_large_star(edges)).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        edges = scratch.stash(stars, f"star-{step}")
        scratch.drop(f"star-{step - 1}")
