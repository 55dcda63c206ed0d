"""The step that the queries over orders and line items share: what is compiled, and that it gives what the trees gave."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from gritsieve.functions import text as tx
from gritsieve.operators import scoring
from gritsieve.operators.rules import classification, classify
from gritsieve.operators.stats import diff_stats
from gritsieve.plans import bindings


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("tables"), random.Random(5)
    spark.createDataFrame([(k, k % 7, date(2024, 1, 1 + k % 28)) for k in range(60)], "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{folder}/orders.parquet")
    lines = [(rng.randrange(60), rng.randrange(90), rng.randrange(12), rng.randint(1, 7), float(rng.randint(1, 50)), rng.choice("ANR")) for _ in range(240)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_quantity double, l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_chains_of_rules_are_compiled_and_equal_the_trees(spark):
    rng = random.Random(1)
    dirs, names = ["src", "tests", "Vendor", "main", "java", "docs", "spec", "dist", "test"], ["a.py", "test_a.py", "b.pb.go", "ATest.java", "x.spec.ts", "README", "Cargo.lock", "m.min.js", "lib.rs", "build.rs", "s.sql"]
    rows = [("/".join([*rng.choices(dirs, k=rng.randrange(4)), rng.choice(names)]), rng.choice([None, [], ["minified"], ["generated-header"], ["rust-inline-tests", "x"]])) for _ in range(300)]
    files = spark.createDataFrame(rows, "path string, signals array<string>")
    found = classify(files)
    assert "aggregate(" not in plan(found)
    one = classification(F.col("path"), F.col("signals"))
    assert found.withColumn("one", one).where("category <> one.category or rule_id <> one.rule_id or category is null").count() == 0


def test_features_are_made_once(spark, tables):
    for query, feature in ((bindings.score_features, "fix_keyword"), (bindings.difficulty_features, "cross_file")):
        rows = query(spark, tables)
        assert plan(rows).count(feature) == 1
        assert rows.where("name is null").count() == 0 and rows.count() > 0


def test_sums_without_lists(spark, tables):
    for lists in (True, False):
        files = classify(bindings.file_changes(spark, tables, lists))
        full, sums = (scoring.evaluate(bindings.commits(spark, tables), diff_stats(files, ["sha"], False, api), keys=["sha"], details=details) for api, details in ((True, True), (None, False)))
        columns = ("sha", "reason", "score", "difficulty", "band")
        assert sorted(map(str, full.select(*columns).collect())) == sorted(map(str, sums.select(*columns).collect()))
    assert full.where("score > 0").count() > 0 and "aggregate(score_features" not in plan(sums)


def test_plain_subjects_equal_split_ones(spark):
    rng = random.Random(2)
    pieces = ["Fix", " ", "\n", "\n\n", "\t", "\r\n", "é", "a.b", " ", "#1", "\x0b", "Bugİ"]
    rows = [("".join(rng.choices(pieces, k=rng.randrange(9))),) for _ in range(1500)] + [(None,), ("x",), ("x \n\ny",), ("\n\nx y\n\nz\n",)]
    split = F.array_join(F.transform(tx._parts(F.col("m"))["head"], tx.strip), " ")
    assert spark.createDataFrame(rows, "m string").where(~tx.subject(F.col("m")).eqNullSafe(split)).count() == 0


def test_first_letters_ahead_of_word_boundaries_change_no_match(spark):
    rng = random.Random(3)
    letters = ["fix", "FİX", "bug", "wrong", "incorrect", "İncorrect", "ıncorrect", "crash", "craſhes", "broKen", "resolve", "Close", "d", "s", "es", " ", ":", "#1", "é", "-", "o/r", "_"]
    rows = spark.createDataFrame([("".join(rng.choices(letters, k=6)),) for _ in range(2000)], "m string")
    for pattern in (tx.FIX_WORD, tx.CLOSING_REFERENCE):
        plain = pattern.replace("(?=[fbrciw])", "").replace("(?=[cfr])", "")
        assert plain != pattern
        assert rows.where(F.regexp_extract("m", pattern, 0) != F.regexp_extract("m", plain, 0)).count() == 0
