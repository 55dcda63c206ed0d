"""Range joins against loops, and the index of rules against the CASE."""

import random

import pytest
from pyspark.sql import functions as F

from gritsieve.operators import intervals
from gritsieve.operators.rule_index import classify_indexed, key_of
from gritsieve.operators.rules import RULES, Rule, classify, with_rules


def ranges(rng, n, name):
    rows = []
    for k in range(n):
        a = rng.choice([rng.randrange(-50, 200), rng.randrange(10**6), None if rng.random() < 0.05 else 7])
        b = None if a is None or rng.random() < 0.03 else a + rng.choice([0, 0, 1, 3, 10, 1000, 10**9, -1])
        rows.append((None if rng.random() < 0.03 else rng.choice("hhhhxy"), a, b, f"{name}{k}"))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_overlaps(spark, seed):
    rng = random.Random(seed)
    left, right = ranges(rng, 150, "l"), ranges(rng, 120, "r") + [("h", 5, 9, "same"), ("h", 5, 9, "same")]
    want = sorted((f, x, y) for f, a, b, x in left for g, c, d, y in right if None not in (f, a, b, c, d) and f == g and a <= b and c <= d and a <= d and c <= b)
    df = lambda rows, n: spark.createDataFrame(rows, f"file string, {n}_from long, {n}_to long, {n} string").repartition(3)
    got = intervals.overlaps(df(left, "a"), df(right, "b"), ["file"], ("a_from", "a_to"), ("b_from", "b_to"))
    assert got.columns == ["file", "a_from", "a_to", "a", "b_from", "b_to", "b"]
    assert sorted(tuple(r) for r in got.select("file", "a", "b").collect()) == want


def test_points_names_and_empty_sides(spark):
    points = spark.createDataFrame([("f", 3), ("f", 9), ("g", 3), ("f", None)], "file string, line int")
    regions = spark.createDataFrame([("f", 1, 3, "a"), ("f", 3, 3, "b"), ("f", 4, 8, "c")], "file string, start int, end int, name string")
    assert sorted(tuple(r) for r in intervals.within(points, regions, ["file"]).select("file", "line", "name").collect()) == [("f", 3, "a"), ("f", 3, "b")]
    assert intervals.within(points.limit(0), regions, ["file"]).count() == intervals.within(points, regions.limit(0), ["file"]).count() == intervals.within(points.limit(0), regions.limit(0), ["file"]).count() == 0
    hunks = spark.createDataFrame([("f", 3, 0), ("f", 7, 5), ("g", 1, 1)], "file string, new_start int, n_added int")
    assert [tuple(r) for r in intervals.touched(hunks, regions, ["file"]).collect()] == [("f", ["a", "b", "c"])]
    with pytest.raises(ValueError):
        intervals.overlaps(regions, regions, ["file"])


def test_a_hot_file_is_spread(spark):
    """All ranges are of one file: the join's key still has many values, and long ranges cost few rows."""
    rows = spark.range(20_000).select(F.lit("f").alias("file"), (F.col("id") * 10).alias("a"), (F.col("id") * 10 + 14).alias("b"), F.col("id").alias("x"))
    more = spark.range(3).select(F.lit("f").alias("file"), F.lit(0).alias("c"), F.lit(10**9).alias("d"), F.col("id").alias("y"))
    got = intervals.overlaps(rows, more, ["file"], ("a", "b"), ("c", "d"))
    assert got.count() == 60_000
    ends = rows.select("file", F.col("a").alias("c"), F.col("b").alias("d"), F.col("x").alias("y"))
    assert intervals.overlaps(rows, ends, ["file"], ("a", "b"), ("c", "d")).count() == 20_000 + 2 * 19_999


def many_rules(n):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    rules = []
    for k in range(n):
        w, v = rng.choice(words), rng.choice(words)
        kind, pattern = rng.choice([("dir", w), ("dir", f"{w}*"), ("name", f"{w}.{v}"), ("name", f"*.{w}"), ("name", f"{w}_*"), ("name", f"*{w}"), ("path", f"**/{w}/*.{{{v},py}}"), ("path", f"{w}/**"), ("path", f"**/{w}?/{v}"), ("name", "{a,b}" + f"[0-9]*.{w}")])
        rules.append(Rule(f"r{k}", rng.choice(["source", "test", "docs"]), kind, (pattern, *([f"{v}.x"] if kind == "name" and k % 3 == 0 else [])), "why", ("python",) if k % 11 == 0 else (), k % 5 == 0, ("**/keep/**",) if k % 7 == 0 else ()))
    return with_rules(rules)


def random_paths(n):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(300)] + ["keep", "tests", "src", "W7", "vendor", "docs"]
    ends = [f"w{k}" for k in range(300)] + ["py", "rs", "test.js", "min.js", "md", "PY"]
    rows = [("/".join(rng.choice(words) for _ in range(rng.randrange(4))) + "/" * rng.randrange(2) + rng.choice(["", "a1", "b2z", "x"]) + rng.choice(words) + rng.choice([".", "_", ""]) + rng.choice(ends), rng.choice([None, [], ["minified"], ["rust-inline-tests", "generated-header"]])) for _ in range(n)]
    return rows + [(None, None), ("", []), ("é.py", None), ("W1/É.w2", None), ("a//b\\w1.w2", None)]


@pytest.mark.parametrize("rules", [RULES, many_rules(200)])
def test_index_gives_what_the_case_gives(spark, rules):
    files = spark.createDataFrame(random_paths(1500), "path string, signals array<string>")
    pick = lambda df: sorted(map(str, df.select("path", "signals", "language", "category", "rule_id").collect()))
    assert pick(classify_indexed(files, rules)) == pick(classify(files, rules))


def first_rule(path, rules):
    """The first rule of simple shapes that applies, by hand: whole names, extensions and directories."""
    *dirs, name = path.lower().split("/")
    for r in rules:
        (p,) = r.patterns
        if (r.kind == "name" and (name == p or p.startswith("*.") and name.endswith(p[1:]))) or (r.kind == "dir" and p in dirs):
            return r.rule_id
    return "fallback"


def test_two_thousand_rules(spark):
    """Too many for one CASE; the plan holds one join whatever their number."""
    rng = random.Random(3)
    kinds = {"name": lambda k: rng.choice([f"n{k}.py", f"*.e{k % 700}"]), "dir": lambda k: f"d{k % 900}"}
    rules = [Rule(f"r{k}", "source", kind, (kinds[kind](k),), "why") for k in range(2000) for kind in [rng.choice(["name", "dir"])]]
    paths = ["/".join(f"d{rng.randrange(4000)}" for _ in range(rng.randrange(3))) + rng.choice(["", "/"]) + rng.choice([f"n{rng.randrange(2500)}.py", f"x.e{rng.randrange(900)}", "y.txt"]) for _ in range(3000)]
    got = classify_indexed(spark.createDataFrame([(p,) for p in paths], "path string"), rules, signals=None).select("path", "rule_id").collect()
    assert [r["rule_id"] for r in got] and all(r["rule_id"] == first_rule(r["path"].lstrip("/"), rules) for r in got)


def test_keys():
    assert key_of("name", "*.PB.go") == ("extension", ".go") and key_of("name", "Makefile") == ("name", "makefile") and key_of("name", "readme*") == ("head", "rea")
    assert key_of("name", "*x") is None and key_of("path", "**/src/main/**") == ("dir", "main") and key_of("path", ".github/**") == ("dir", ".github") and key_of("path", "**/*.rs") == ("extension", ".rs")
