"""The ledger and ordered dedupe against a plain sequential model."""

import random

import pytest
from pyspark.sql import functions as F

from gritsieve.operators import dedupe
from gritsieve.operators.components import connected_components
from gritsieve.scratch import Scratch
from gritsieve.streaming.ledger import Ledger, LedgerConflict, LedgerError, State
from gritsieve.streaming.resume import mode, stream_unseen

SCHEMA = "ord long, repo string, sha string, subject string, hunks array<string>"


def proposals(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("ord", "repo", "sha", "subject", dedupe.fingerprint_of(F.col("hunks")).alias("fingerprint"))


def model(rows, least, keep_overlaps, own_first, held=()):
    """One proposal after the other over plain dictionaries."""
    held, out = list(held), []
    for ord_, repo, sha, _, hunks in rows:
        if not hunks:
            out.append((ord_, "unknown", []))
            continue
        patch, distinct = tuple(sorted(hunks)), set(hunks)
        own = next((e for e in held if (e["repo"], e["sha"]) == (repo, sha)), None)
        exact = next((e for e in held if e["patch"] == patch), None)
        if own_first and own:
            out.append((ord_, "duplicate", [own["ord"]]))
            continue
        found = [(e, len(distinct & e["set"]) / min(len(distinct), len(e["set"])), len(distinct & e["set"])) for e in held if e is not exact and distinct & e["set"]]
        found = sorted([f for f in found if f[1] >= least], key=lambda f: (-f[1], -f[2], f[0]["ord"]))
        matches = ([exact["ord"]] if exact else []) + [e["ord"] for e, *_ in found]
        status = "duplicate" if exact else "overlap" if matches else "new"
        if not own and (status == "new" or (keep_overlaps and not exact)):
            held.append({"ord": ord_, "repo": repo, "sha": sha, "patch": patch, "set": distinct})
        out.append((ord_, status, matches))
    return out


def test_fold_against_a_ledger(spark):
    """Entries that were there before take part like rows judged earlier."""
    before, rows = [r for r in cases(4, 25) if r[4]], [(k + 100, *r[1:]) for k, r in enumerate(cases(5, 40))]
    held = {o for o, status, _ in model(before, 2.0, False, True) if status == "new"}  # no overlap reaches 2: unique fixes and commits
    entries = [(r[0], r) for r in before if r[0] in held]
    ledger = spark.createDataFrame([(k, "", r[1], r[2], "", "proposed", None, "2024", len(set(r[4]))) for k, r in entries], dedupe.ENTRIES)
    prints = proposals(spark, [r for _, r in entries]).select(F.col("ord").alias("id"), F.col("fingerprint.patch").alias("p"))
    ledger = ledger.join(prints, "id").select("id", F.col("p").alias("fingerprint"), *ledger.columns[2:])
    hunks = spark.createDataFrame([(k, h) for k, r in entries for h in set(r[4])], dedupe.HUNKS)
    got = dedupe.fold_in_order(proposals(spark, rows), ledger, hunks, Scratch(spark, "t"), 0.5).orderBy("ord").collect()
    assert [(r["ord"], r["status"], [m["id"] if m["id"] >= 0 else -m["id"] - 1 for m in r["matches"]]) for r in got] == model_after([r for _, r in entries], rows)


def model_after(entries, rows):
    held = [{"ord": r[0], "repo": r[1], "sha": r[2], "patch": tuple(sorted(r[4])), "set": set(r[4])} for r in entries]
    return model(rows, 0.5, False, True, held)


def cases(seed, n=60):
    rng = random.Random(seed)
    return [(k, f"r{rng.randint(0, 2)}", f"s{rng.randint(0, 40)}", "", [f"h{rng.randint(0, 25)}" for _ in range(rng.randint(0, 4))]) for k in range(n)]


@pytest.mark.parametrize("seed, keep, own", [(1, False, True), (2, True, False), (3, False, True)])
def test_fold_equals_one_after_the_other(spark, seed, keep, own):
    rows = cases(seed)
    entries, hunks = (spark.createDataFrame([], s) for s in (dedupe.ENTRIES, dedupe.HUNKS))
    got = dedupe.fold_in_order(proposals(spark, rows), entries, hunks, Scratch(spark, "t"), 0.5, keep, own).orderBy("ord").collect()
    assert [(r["ord"], r["status"], [-m["id"] - 1 for m in r["matches"]]) for r in got] == model(rows, 0.5, keep, own)


def test_prefix_join_equals_all_pairs(spark):
    rows = [r for r in cases(7, 80) if r[4]]
    df = proposals(spark, rows)
    sets = dedupe.hunk_rows(df)
    got = {(r["ord"], r["id"]): (r["shared"], r["smaller"]) for r in dedupe.shared_hunks(sets, sets.withColumnRenamed("ord", "id"), 0.6).collect()}
    want = {}
    for a in rows:
        for b in rows:
            x, y = set(a[4]), set(b[4])
            if x & y and len(x & y) / min(len(x), len(y)) >= 0.6:
                want[(a[0], b[0])] = (len(x & y), min(len(x), len(y)))
    assert got == want


def test_verdicts_order_matches(spark):
    entries = spark.createDataFrame([(1, "p1", "a", "s1", "", "proposed", None, "2024", 4), (2, "p2", "b", "s2", "", "claimed", "me", "2024", 2), (3, "p3", "c", "s3", "", "proposed", None, "2024", 2)], dedupe.ENTRIES)
    hunks = spark.createDataFrame([(1, h) for h in "wxyz"] + [(2, "x"), (2, "y"), (3, "q"), (3, "r")], dedupe.HUNKS)
    rows = proposals(spark, [(0, "a", "n", "", ["x", "y"]), (1, "a", "m", "", ["n1"]), (2, "a", "k", "", [])])
    got = {r["ord"]: (r["status"], [(m["entry"]["id"], m["shared"], m["smaller"]) for m in r["matches"]]) for r in dedupe.verdicts(rows, entries, hunks).collect()}
    assert got == {0: ("overlap", [(1, 2, 2), (2, 2, 2)]), 1: ("new", []), 2: ("unknown", [])}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(120)] + [(5000, 5001 + k) for k in range(200)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "cc")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "cc")).count() == 0


def fix(k, *hunks):
    return {"repo": "r", "sha": f"s{k}", "subject": f"fix {k}", "hunks": list(hunks)}


def test_add_claim_and_refuse(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    entry, verdict = ledger.add(fix(1, "a", "b"), "proposed")
    assert verdict["status"] == "new" and entry["status"] == "proposed"
    assert ledger.add(fix(2, "a", "c"))[1]["status"] == "overlap"
    taken, verdict = ledger.add(fix(3, "a", "b"), owner="me")
    assert verdict["status"] == "duplicate" and taken["status"] == "claimed" and taken["owner"] == "me"
    assert ledger.add(fix(4, "a", "b"))[0] is None and ledger.add(fix(5))[1]["status"] == "unknown"
    assert ledger.add(fix(1, "z"), least=None)[1]["status"] == "duplicate"
    assert ledger.entries().count() == 1 and ledger.table("hunks").count() == 2
    with pytest.raises(LedgerError):
        ledger.add(fix(9, "q"), "lost")


def test_one_of_two_writers_wins(spark, tmp_path):
    one, two = (Ledger(spark, str(tmp_path / "l")) for _ in range(2))
    one.begin()
    two.begin()
    one.commit()
    with pytest.raises(LedgerConflict):
        two.commit()
    assert one.state() == State(1, {t: () for t in ("entries", "hunks", "watermarks", "walked")})


def test_a_crash_before_the_rename_changes_nothing(spark, tmp_path):
    """A commit that was written but not renamed is invisible, and the next writer goes on."""
    ledger = Ledger(spark, str(tmp_path / "l"))
    entry, _ = ledger.add({"repo": "r", "sha": "1", "subject": "s", "hunks": ["a"]})
    assert entry and ledger.state().number == 1
    (tmp_path / "l" / "commits" / ".half.part").write_text('{"vers')
    assert Ledger(spark, str(tmp_path / "l")).state() == ledger.state()
    assert ledger.add({"repo": "r", "sha": "2", "subject": "s", "hunks": ["b"]})[0] and ledger.state().number == 2
    assert sorted(x.name for x in (tmp_path / "l" / "commits").iterdir() if x.name.endswith(".json")) == ["000000000001.json", "000000000002.json"]


def test_record_accumulates(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    rows = proposals(spark, [(0, "r", "a", "", ["x", "y"]), (1, "r", "b", "", ["x", "z"]), (2, "r", "c", "", ["y", "x"])])
    walked = spark.createDataFrame([("r", "clone", s) for s in "abcd"], "repo string, source string, sha string")
    marks = spark.createDataFrame([("r", "clone", "d")], "repo string, source string, position string")
    got = {r["ord"]: (r["status"], [m["sha"] for m in r["matches"]]) for r in ledger.record(rows, walked, marks).collect()}
    assert got == {0: ("new", []), 1: ("overlap", ["a"]), 2: ("duplicate", ["a"])}
    again = {r["ord"]: r["status"] for r in ledger.record(rows, walked, marks).collect()}
    assert again == {0: "duplicate", 1: "overlap", 2: "duplicate"}
    mark = ledger.watermark("r", "clone")
    assert (mark["walked"], mark["runs"], mark["position"]) == (8, 2, "d") and ledger.seen("r", "clone").count() == 4
    check = {r["ord"]: r["status"] for r in ledger.check(proposals(spark, [(0, "q", "n", "", ["k"]), (1, "q", "m", "", ["k", "l"])])).collect()}
    assert check == {0: "new", 1: "overlap"} and ledger.entries().count() == 1


def test_modes():
    assert [mode(None, False, 1), mode("a", True, 0), mode("a", False, 2), mode("a", False, 0)] == ["first", "full", "resumed", "up-to-date"]


def test_stream_gives_each_key_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), []
    spark.createDataFrame([(1, "a"), (2, "b"), (1, "a")], "sha long, x string").write.parquet(source)

    def go():
        stream = spark.readStream.schema("sha long, x string").parquet(source)
        stream_unseen(stream, ["sha"], lambda df, n: out.append(sorted(r["sha"] for r in df.collect())), str(tmp_path / "cp"), str(tmp_path / "walked")).awaitTermination()

    go()
    spark.createDataFrame([(2, "b"), (3, "c")], "sha long, x string").write.mode("append").parquet(source)
    go()
    assert [x for batch in out for x in batch] == [1, 2, 3]
