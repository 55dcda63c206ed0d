"""The index of evaluated keys against a set, increment by increment."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritsieve.streaming import key_index
from gritsieve.streaming.key_index import KeyIndex


def keys_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_increments_against_a_set(spark, tmp_path):
    rng, held = random.Random(2), set()
    index = KeyIndex(spark, f"file://{tmp_path}/i", ["repo", "sha"], buckets=4)
    schema = "repo string, sha string, x int"
    for number in range(8):
        rows = [(rng.choice(["a", "b", None]), rng.choice([None, *map(str, range(60))]), k) for k in range(rng.choice([0, 5, 40]))]
        df = spark.createDataFrame(rows, schema)
        assert keys_of(index.unseen(df)) == sorted([r for r in rows if r[:2] not in held], key=str)
        assert keys_of(index.seen(df)) == sorted({r[:2] for r in rows} & held, key=str)
        index.add(df, number)
        held |= {r[:2] for r in rows}
        assert index.increments() == list(range(number + 1))


def test_fifty_increments_are_merged_and_replaced(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(key_index, "MANY", 12)
    index = KeyIndex(spark, f"file://{tmp_path}/i", ["k"], buckets=2)
    for number in range(14):
        index.add(spark.range(number * 10, number * 10 + 10).withColumnRenamed("id", "k"), number)
        index.compact()
    assert len(index.increments()) < 12 and index.increments()[0] < 0
    probe = spark.range(200).withColumnRenamed("id", "k")
    assert [r["k"] for r in index.unseen(probe).orderBy("k").collect()] == list(range(140, 200))
    index.add(spark.range(500, 505).withColumnRenamed("id", "k"), 13)  # the newest is written again with other keys
    assert index.seen(spark.range(130, 140).withColumnRenamed("id", "k")).count() == 0 and index.seen(spark.range(500, 600).withColumnRenamed("id", "k")).count() == 5
    assert index.seen(probe, ignore=13).count() == 130


@pytest.mark.parametrize("block", [1, 30, 10**6])
def test_many_new_keys_are_broadcast_in_blocks(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(key_index, "BLOCK", block)
    index = KeyIndex(spark, f"file://{tmp_path}/i", ["k"], buckets=3)
    index.add(spark.range(0, 40, 2).withColumnRenamed("id", "k"), 1)
    index.add(spark.range(0, 40, 5).withColumnRenamed("id", "k"), 2)
    assert [r["k"] for r in index.seen(spark.range(60).withColumnRenamed("id", "k")).orderBy("k").collect()] == [k for k in range(40) if k % 2 == 0 or k % 5 == 0]


def test_old_keys_are_neither_shuffled_nor_read_for_nothing(spark, tmp_path):
    index = KeyIndex(spark, f"file://{tmp_path}/i", ["k"], buckets=8)
    for number in range(3):
        index.add(spark.range(number * 1000, number * 1000 + 1000).withColumnRenamed("id", "k"), number)
    asks = index._keyed(spark.range(5, 6).withColumnRenamed("id", "k"))
    pointed = index._pointed(asks, index.increments()).collect()
    assert 0 in {r["number"] for r in pointed} and len({r["bucket"] for r in pointed}) == 1 and len(pointed) <= 2
    folder = f"file://{tmp_path}/i/keys/0/__bucket={pointed[0]['bucket']}"
    plan = index._found([folder], asks, F.col("k").eqNullSafe(F.col("__old_k")))._jdf.queryExecution().executedPlan().toString()
    old = plan[: plan.index("Scan parquet")].splitlines()
    assert "BroadcastHashJoin" in plan and sum("Exchange hash" in line for line in old) == 1  # of the keys found, for distinct


def test_filters():
    rng = np.random.default_rng(1)
    held, others = rng.integers(-(2**62), 2**62, 5000), rng.integers(-(2**62), 2**62, 20_000)
    bits = key_index.bloom(held)
    assert key_index.may_hold(bits, held).all() and key_index.may_hold(bits, others).mean() < 0.02 and len(bits) < 5000 * 1.3
