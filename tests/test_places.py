"""Places within hot groups, and what is built on them."""

import random

from pyspark.sql import functions as F

from gritsieve.operators import summaries
from gritsieve.operators.places import placed


def test_places_in_hot_groups(spark):
    """A group that holds most rows is numbered over several ranges; groups and ties keep their order."""
    rng = random.Random(3)
    rows = [(None if k % 50 == 0 else "hot" if k % 10 else f"g{k % 7}", rng.randint(0, 400), k) for k in range(3000)]
    frame = spark.createDataFrame(rows, "g string, v int, k int")
    order = [F.col("v").desc(), F.col("k").asc()]
    found = placed(frame, ["g"], order, "place")
    assert found.columns == ["g", "v", "k", "place"]
    want = []
    for group in {r[0] for r in rows}:
        want += [(*r, n) for n, r in enumerate(sorted((r for r in rows if r[0] == group), key=lambda r: (-r[1], r[2])), 1)]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    assert placed(frame.limit(0), ["g"], order, "place").count() == 0


def test_columns_of_the_caller_stay(spark):
    names = ("__range", "__own", "__at", "__before", "___RANGE")
    frame = spark.range(20).withColumns({c: F.lit(7) for c in names})
    found = placed(frame, [], [F.desc("id")], "place")
    assert found.columns == [*frame.columns, "place"]
    assert [tuple(r) for r in found.orderBy("place").collect()] == [(19 - k, *[7] * 5, k + 1) for k in range(20)]


def test_rejected_lists_come_in_parts(spark):
    rows = [("r", f"{k:04d}", k, "empty" if k % 3 else "oversize") for k in range(100)] + [("r", "x", 500, None)]
    got = summaries.rejected_lists(spark.createDataFrame(rows, "repo string, sha string, pos long, reason string"), most=30).orderBy("reason", "part").collect()
    assert [(r["reason"], r["part"], len(r["shas"])) for r in got] == [("empty", 0, 30), ("empty", 1, 30), ("empty", 2, 6), ("oversize", 0, 30), ("oversize", 1, 4)]
    assert [s for r in got for s in r["shas"]] == [r[1] for reason in ("empty", "oversize") for r in rows if r[3] == reason]
