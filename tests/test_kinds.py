"""Overlaps by kinds of fixes against all pairs."""

import random

from pyspark.sql import functions as F

from gritsieve.operators import dedupe, kinds
from gritsieve.scratch import Scratch


def fixes(seed=5, n=60):
    """Many small fixes around two common hunks, and some that share several."""
    rng, common = random.Random(seed), [f"c{k}" for k in range(5)]
    rows = [(f"p{k}", ["c0", f"own{k}"]) for k in range(n)] + [(f"q{k}", ["c0", "c1", f"mine{k}"]) for k in range(n)]
    rows += [(f"r{k}", rng.sample(common, rng.randint(1, 4)) + [f"x{k}_{j}" for j in range(rng.randint(0, 4))]) for k in range(n)]
    return rows + [("alone", ["nothing", "else"])]


def test_kinds_stand_for_all_pairs(spark):
    rows = fixes()
    sets = spark.createDataFrame([(p, len(h), x) for p, h in rows for x in h], "patch string, n int, hash string")
    found = kinds.kinds_of(sets, 0.5, Scratch(spark, "test-kinds"))
    kind = {r["patch"]: r["kind"] for r in found.members.collect()}
    pairs = {(r["kind"], r["other"]): (r["shared"], r["smaller"]) for r in found.pairs.collect()}
    assert len({kind[f"p{k}"] for k in range(60)}) == len({kind[f"q{k}"] for k in range(60)}) == 1 and "alone" not in kind
    want = {}
    for p, a in rows:
        for q, b in rows:
            shared, smaller = len({*a} & {*b}), min(len(a), len(b))
            if p != q and shared / smaller >= 0.5:
                want[p, q] = (shared, smaller)
    assert {(p, q): pairs[kind[p], kind[q]] for p in kind for q in kind if p != q and (kind[p], kind[q]) in pairs} == want
    assert len(pairs) * 4 < len(want)  # pairs of fixes, as they were listed before, are many times as many


def test_lines_are_hashed_in_one_place(spark):
    rows = spark.createDataFrame([("a  b\nc",)], "text string").select(dedupe.fingerprint_of(F.transform(F.split("text", "\n"), lambda x: F.sha1(x.cast("binary")))).alias("f"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha1(") + plan.count("sha(") == 1


def test_pairs_meet_once_and_only_where_enough_is_left(spark):
    """Sets that share their most held hashes below the threshold, in both directions of size."""
    rng = random.Random(8)
    rows = [(f"k{k}", {f"h{int(rng.triangular(0, 30, 0))}" for _ in range(rng.randint(2, 14))}) for k in range(90)]
    sets = spark.createDataFrame([(p, len(h), x) for p, h in rows for x in h], "kind string, n int, hash string")
    want = {(p, q): (len(a & b), min(len(a), len(b))) for p, a in rows for q, b in rows if len(a & b) / min(len(a), len(b)) >= 0.6}
    ordered = kinds._ordered(sets, "kind", kinds._rarity(sets, sets), 0.6)
    within = [((r["kind"], r["other"]), (r["shared"], r["smaller"])) for r in kinds._within(ordered, 0.6).collect()]
    both = [((r["kind"], r["id"]), (r["shared"], r["smaller"])) for r in kinds.shared_hunks(sets, sets.withColumnRenamed("kind", "id"), 0.6, "kind", "id").collect()]
    assert dict(within) == dict(both) == want and len(within) == len(both) == len(want)
    met = {tuple(r) for r in kinds._candidates(ordered, ordered.withColumnRenamed("kind", "other"), "kind", "other", "na < nb or (na = nb and kind <= other)").collect()}
    held = {k: {*h} for k, h in rows}
    assert len(met) * 2 < sum(1 for a in held.values() for b in held.values() if a & b)


def test_earlier_rows_are_counted_where_fewer_have_to_go(spark):
    """Many small kinds around a large one: each asks with its own rows, and the large one is asked by all."""
    rng, names = random.Random(3), [f"k{k}" for k in range(40)]
    pairs = [(a, b) for a in names for b in names if a == b or "k0" in (a, b) or rng.random() < 0.1]
    pairs = sorted({*pairs, *((b, a) for a, b in pairs)})
    place = [("k0" if rng.random() < 0.8 else rng.choice(names)) for _ in range(1500)]
    rows = [(n, k) for n, k in enumerate(place)]
    held = [(k, n) for n, k in rows if n % 3] + [("k0", -1), ("k7", -1), ("k7", -1)]
    found = kinds.Kinds(None, spark.createDataFrame([(a, b, 1, 1) for a, b in pairs], "kind string, other string, shared int, smaller int"))
    sides = spark.createDataFrame(held, "kind string, since long"), spark.createDataFrame(rows, "ord long, kind string")
    near = {*pairs}
    want = {n: sum(since < n and (k, other) in near for other, since in held) for n, k in rows}
    got = kinds.earlier(found, *sides).collect()
    assert {r["ord"]: r["earlier"] for r in got} == want and len(got) == len(rows)
    # by kind and entry, as they were counted before, 40 copies of the large kind's rows
    every = sum((k, other) in near for k in {k for _, k in rows} for other, _ in held)
    assert kinds.timelines(found, *sides).count() * 5 < every


def test_the_smaller_side_of_a_pair_of_kinds_moves(spark, monkeypatch):
    """Large kinds with many small ones around them, rows without an entry, and a kind whose fixes differ."""
    rng, names = random.Random(4), [f"k{k}" for k in range(30)]
    pairs = {(a, b) for a in names for b in names if a == b or "k0" in (a, b) or rng.random() < 0.2}
    pairs = sorted(pairs | {(b, a) for a, b in pairs})
    member = {f"p{k}": "k0" if k % 3 else rng.choice(names) for k in range(240)}
    rows = [(k, rng.choice(sorted(member))) for k in range(400)]
    entries = [(k, p) for k, p in enumerate(sorted(member)) if k % 5]
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    found = kinds.Kinds(frame(list(member.items()), "patch string, kind string"), frame([(a, b, 1, 2) for a, b in pairs], "kind string, other string, shared int, smaller int"))
    left, right, near = frame(rows, "ord long, patch string"), frame(entries, "id long, patch string"), {*pairs}
    want = sorted((o, i, 1, 2) for o, p in rows for i, q in entries if p != q and (member[p], member[q]) in near)
    assert sorted(map(tuple, kinds.pairs_of(found, left, right).collect())) == want
    with monkeypatch.context() as few:  # a large kind has several lists
        few.setattr(kinds, "LISTED", 20)
        assert sorted(map(tuple, kinds.pairs_of(found, left, right).collect())) == want
    # as it was before, the rows of a kind went to each kind that it meets
    every = sum(1 for _, p in rows for a, b in pairs if a == member[p])
    go, come = kinds.meetings(found, kinds._lists(left, found, "ord", "left"), kinds._lists(right, found, "id", "right"))
    moved = sum(r[0] or 0 for side, name in ((go, "left"), (come, "right")) for r in side.agg(F.sum(F.size(name))).collect())
    assert 0 < moved * 5 < every


def around_one_hunk(spark, n=240):
    """A hunk that most fixes hold: a kind of many fixes, and many small kinds around it."""
    rng = random.Random(6)
    member = {f"p{k}": "k0" if k % 2 else f"k{rng.randint(1, 40)}" for k in range(n)}
    pairs = sorted({(a, b) for a in {*member.values()} for b in {*member.values()} if a == b or "k0" in (a, b)})
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    found = kinds.Kinds(frame(list(member.items()), "patch string, kind string"), frame([(a, b, 1, 1 + len(a)) for a, b in pairs], "kind string, other string, shared int, smaller int"))
    rows, entries = [(k, f"p{k % n}") for k in range(2 * n)], [(k, f"p{k}") for k in range(n)]
    near = {*pairs}
    want = sorted((o, i, 1, 1 + len(member[p])) for o, p in rows for i, q in entries if p != q and (member[p], member[q]) in near)
    return found, frame(rows, "ord long, patch string"), frame(entries, "id long, patch string"), want


def test_pairs_around_one_hunk_are_made_in_many_tasks(spark, monkeypatch):
    found, left, right, want = around_one_hunk(spark)
    monkeypatch.setattr(kinds, "LISTED", 10)
    monkeypatch.setattr(kinds, "DEALT", len(want) // 16, raising=False)
    pairs = kinds.pairs_of(found, left, right)
    made = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert sorted(map(tuple, pairs.collect())) == want
    assert max(made) * 5 < sum(made) == len(want)


def test_a_row_explodes_to_one_list_in_a_stage_of_code(spark):
    """Both lists in one stage: all pairs of two lists, a million, would be held before the first goes on."""
    found, left, right, _ = around_one_hunk(spark, 20)
    plan = kinds.pairs_of(found, left, right)._jdf.queryExecution().executedPlan().toString()
    between = plan[plan.index("Generate explode(right") :]
    assert "Union" in between[: between.index("Generate explode(left")]
