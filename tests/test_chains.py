"""Chains of rules by endings, and measures without lists of names, against the plain forms."""

from pyspark.sql import functions as F

from gritsieve.functions.text import let
from gritsieve.operators.rule_index import classify_indexed
from gritsieve.operators.rules import ENDINGS, RULES, Rule, classification, classify
from gritsieve.operators.stats import diff_stats
from gritsieve.plans import bindings

NAMES = ["py", "a.py", "A.PY", "go", "go.sum", "go.mod", "x.go", "setup.py", "build.rs", "a.lock", "MAKEFILE", "a.mk", "readme", "readme.md", "README.rs", "package.json", "a.min.js", "a.min.css", "deno.jsonc", ".eslintrc.js", "requirements-x.txt", "t.generated.md", "zz_generated_a.go", "FooTest.java", "x.foo", ".py", "a.", ""]


def test_a_chain_leaves_out_what_its_names_can_not_be():
    by_id = {r.rule_id: r for r in RULES}
    python, other = ENDINGS[0].__contains__, lambda e: not any(e in group for group in ENDINGS)
    assert by_id["lockfile"].open_to(python) == () and by_id["py-config-file"].open_to(python) == (("is", "setup.py"), ("is", "noxfile.py"), ("around", ".readthedocs.y", "ml"))
    assert ("around", "", ".lock") in by_id["lockfile"].open_to(other) and by_id["py-source"].open_to(other) == ()
    assert sum(len(r.open_to(python)) for r in RULES) * 3 < sum(len(r.open_to(lambda _: True)) for r in RULES)


def test_chains_give_what_the_index_gives(spark):
    rules = (Rule("upper", "test", "name", ("*.PY", "GO"), "why", (), True), Rule("plain", "test", "dir", ("Keep",), "why", (), True), *RULES)
    rows = [(d + n, s) for d in ("", "Keep/", "keep/", "docs/", "src/main/java/docs/") for n in NAMES for s in (None, ["minified", None], ["generated-header"])] + [(None, None)]
    files = spark.createDataFrame(rows, "path string, signals array<string>")
    pick = lambda df: sorted(map(str, df.select("path", "signals", "language", "category", "rule_id").collect()))
    got = pick(classify(files, rules))
    assert got == pick(classify_indexed(files, rules))
    both = classify(files.withColumn("c", classification(F.col("path"), F.col("signals"), rules)), rules)
    assert both.where("c.rule_id <> rule_id or c.category <> category").count() == 0


def test_a_typed_let_asks_for_no_type(spark):
    row = spark.range(2).select(let(F.when(F.col("id") > 0, F.col("id")), lambda x: F.struct((x + x).alias("a")), "struct<a:bigint>").alias("r")).collect()
    assert [r["r"]["a"] for r in row] == [None, 2]
    plan = spark.range(1).select(classification(F.concat(F.lit("a"), F.col("id").cast("string"))))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and "transform(" not in plan


def test_any_api_is_a_list_with_names(spark):
    files = classify(bindings.file_changes(spark, "/root/testdata/sf0.001"))
    names = diff_stats(files, ["sha"], lists=False).select("sha", F.coalesce(F.size("public_api") > 0, F.lit(False)).alias("want"))
    got = diff_stats(files, ["sha"], lists=False, api=None).select("sha", "any_api").join(names, "sha")
    assert got.where("any_api <> want or any_api is null").count() == 0 and got.where("any_api").count() > 10
