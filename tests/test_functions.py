"""Column functions and scanners on small tables of cases."""

import time

import pytest
from pyspark.sql import functions as F

from gritsieve.functions import measure, signals, text as tx
from gritsieve.functions.globs import GlobError, check_pattern, component_regex, expand_braces, path_regex
from gritsieve.functions.lexing import FoundTest, code_of, comment_regions, defined_tests, inline_test_regions, public_names, without_comment
from gritsieve.functions.lexing import test_ranges as ranges_of_tests
from gritsieve.functions.patches import FilePatch, Hunk, PatchError, hunks_from_unified, parse_patch
from gritsieve.operators.rules import RULES, Rule, classify, with_rules
from gritsieve.sources.contents import detect

PATHS = [
    ("vendor/x/tests/a.go", "vendored", "vendored-dir"), ("src/test/resources/a.bin", "test", "java-test-dir"), ("tests/data/x.json", "test", "test-dir"),
    ("web/__mocks__/a.css", "test", "js-test-dir"), ("spec/helpers/a.js", "test", "js-spec-dir"), ("pkg/spec/a.go", "source", "go-source"), ("x/testdata/a.txt", "test", "go-testdata-dir"),
    ("Cargo.lock", "generated", "lockfile"), ("api/a.pb.go", "generated", "generated-name"), ("a.min.js", "generated", "minified-name"), ("dist/a.js", "generated", "js-dist-dir"), ("dist/a.py", "source", "py-source"),
    ("pkg/test_a.py", "test", "py-test-file"), ("src/a.spec.TSX", "test", "js-test-file"), ("a_test.go", "test", "go-test-file"), ("src/FooTest.java", "test", "java-test-file"),
    ("src/Latest.java", "source", "java-source"), ("src/main/java/FooTest.java", "source", "java-source"), ("src/main/java/com/vendor/test/A.java", "source", "java-source"), ("src/a_tests.rs", "test", "rust-test-file"),
    (".github/workflows/a.yml", "config", "ci-config"), ("sub/.github/a.yml", "other", "fallback"), ("Makefile", "config", "build-config"), ("setup.py", "config", "py-config-file"), ("clippy.toml", "config", "rust-config-file"),
    ("build.rs", "config", "rust-build-script"), ("src/build.rs", "source", "rust-source"), ("biome.jsonc", "config", "js-config-file"), ("go.mod", "config", "go-config-file"), ("build.gradle.kts", "config", "java-config-file"),
    ("docs/conf.py", "docs", "docs-dir"), ("a.rst", "docs", "docs-file"), ("examples/a.py", "other", "tooling-dir"), ("a.pyx", "source", "py-source"), ("a.rs", "source", "rust-source"), ("a.mts", "source", "js-source"),
    ("a.go", "source", "go-source"), ("A.java", "source", "java-source"), ("LICENSE-MIT", "docs", "docs-name"), ("license.py", "source", "py-source"), ("./tests\\a.c", "test", "test-dir"), (".js", "other", "fallback"), ("x.unknown", "other", "fallback"),
]
SIGNALS = [("a.py", ["generated-header"], "generated", "generated-header"), ("a.js", ["minified"], "generated", "minified-content"), ("a.ts", ["minified"], "source", "js-source"), ("a.rs", ["rust-inline-tests"], "source", "rust-inline-tests"), ("a.txt", ["generated-header"], "docs", "docs-file")]


def test_every_rule_classifies(spark):
    rows = [(p, [], c, r) for p, c, r in PATHS] + [tuple(x) for x in SIGNALS]
    got = classify(spark.createDataFrame(rows, "path string, signals array<string>, want string, rule string")).collect()
    assert [(r["path"], r["category"], r["rule_id"]) for r in got] == [(r["path"], r["want"], r["rule"]) for r in got]
    assert {r.rule_id for r in RULES} <= {r for _, _, r in PATHS} | {r for *_, r in SIGNALS}


def test_rules_are_checked():
    with pytest.raises(ValueError):
        Rule("Bad Id", "test", "dir", ("a",), "r")
    with pytest.raises(ValueError):
        with_rules([Rule("a", "test", "dir", ("a",), "r")] * 2)
    assert with_rules([], ["docs-dir"])[0].rule_id == "vendored-dir" and len(with_rules([], ["docs-dir"])) == len(RULES) - 1


@pytest.mark.parametrize("pattern, path, hit", [
    ("**/x", "x", True), ("**/x", "a/b/x", True), ("a/**/b", "a/b", True), ("a/**/b", "a/c/d/b", True), ("a/**", "a", False), ("a/**", "a/b/c", True),
    ("*.py", "a/b.py", False), ("[!a]b", "cb", True), ("[!a]b", "ab", False), ("a[]]b", "a]b", True), ("{a,b}/?", "b/z", True), ("a**b/c", "axb/c", True), ("A/b", "a/B", True), ("a.b", "axb", False), ("**/**/x", "x", True),
])
def test_path_globs(spark, pattern, path, hit):
    assert spark.range(1).select(F.lit(path).rlike("(?iu)" + path_regex([pattern]))).first()[0] is hit


def test_glob_checks():
    assert expand_braces("{a,b}.{c,d}") == ("a.c", "a.d", "b.c", "b.d") and expand_braces("[{]a}") == ("[{]a}",)
    for pattern, kind in (("", "path"), ("a\\b", "path"), ("a/b", "component"), ("/a", "path"), ("a/", "path"), ("a//b", "path"), ("[z-a]", "component"), ("{,a}", "component"), ("{a,b}" * 9, "component")):
        with pytest.raises(GlobError):
            check_pattern(pattern, kind)
    assert component_regex(["a*"])


def _one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("message, value, detail", [
    ("Fixes #12", 1.0, "Fixes #12"), ("closes: o/r#3 now", 1.0, "closes: o/r#3"), ("resolved https://github.com/o/r/issues/4", 1.0, "resolved https://github.com/o/r/issues/4"),
    ("see #5", 0.5, "#5"), ("gh-7", 0.5, "gh-7"), ("a&#39;b", 0.0, "no issue or pull-request reference"), ("prefix #12", 0.5, "#12"), ("x/#9", 0.0, "no issue or pull-request reference"), ("", 0.0, "no issue or pull-request reference"),
])
def test_references(spark, message, value, detail):
    assert tuple(_one(spark, tx.linked_reference(F.lit(message)))) == (value, detail)


def test_messages(spark):
    rows = [("\n one \n two\n\n\nbody\n x \n", "one two", "body\n x"), ("", "", ""), ("a\r\nb\r\n\r\nc", "a b", "c"), ("only", "only", "")]
    got = spark.createDataFrame(rows, "m string, s string, b string").select("s", "b", tx.subject(F.col("m")).alias("x"), tx.body(F.col("m")).alias("y")).collect()
    assert [(r["x"], r["y"]) for r in got] == [(r["s"], r["b"]) for r in got]
    assert tuple(_one(spark, tx.fix_keyword(F.lit("Prefixes only"), F.array(F.lit("C-bug"))))) == (1.0, "label 'C-bug'")
    assert tuple(_one(spark, tx.fix_keyword(F.lit("fixé")))) == (0.0, "no fix keyword in the subject")
    texts = F.array(F.lit("fixes #2, closes o/R#10, resolves https://github.com/x/y/issues/1"), F.lit("Fix #2"))
    assert _one(spark, tx.linked_issues(texts, F.lit("O/r"))) == ["#2", "#10", "x/y#1"]


@pytest.mark.parametrize("deleted, added", [
    (["a  b"], ["a b"]), (["a"], ["  a "]), (["x = 1"], ["x = 2"]), ([], ["", " "]), (["\ta b"], ["a c"]), (["a", "b"], ["b", "a"]), (["{} {}"], ["{}{}"]),
])
def test_hunk_hash_is_the_same_on_both_sides(spark, deleted, added):
    arrays = [F.array(*map(F.lit, x)).cast("array<string>") for x in (deleted, added)]
    assert _one(spark, tx.hunk_hash(*arrays)) == measure.hunk_hash(deleted, added)


def test_hunk_hash_ignores_what_a_port_changes():
    assert measure.hunk_hash(["  a = 1"], ["\ta = 2"]) == measure.hunk_hash(["a =  1", ""], ["a = 2"])
    assert measure.hunk_hash(["a"], [" a"]) is None and measure.hunk_hash(["'a  b'"], ["'a b'"]) is not None


def test_urls(spark):
    for url, want in (("https://u:p@h/x", "https://h/x"), ("ssh://git:p@h/x", "ssh://git@h/x"), ("https://h/a@b", "https://h/a@b"), ("git@h:x", "git@h:x"), ("https://a@b@h/", "https://h/")):
        assert _one(spark, tx.strip_credentials(F.lit(url))) == want
    assert _one(spark, tx.strip_credentials(F.lit(None).cast("string"))) is None


SNIPPETS = [
    ("python", b"# @generated\nx = 1\n", ["generated-header"]), ("go", b"// Code generated by x. DO NOT EDIT.\n", ["generated-header"]), ("python", b"# Include the auto-generated bindings\n", []),
    ("rust", b"// This file is automatically generated\n#[cfg(test)]\nmod t {}\n", ["generated-header", "rust-inline-tests"]), ("javascript", b"a" * 600, ["minified"]), ("javascript", b"a\n" * 600, []),
    ("java", b"/*\n * Auto-generated by y\n */\n", ["generated-header"]), ("python", b"\n" * 30 + b"# @generated\n", []), ("rust", b"  #[cfg(all(test, x))]\n", ["rust-inline-tests"]),
]


def test_signals_agree(spark):
    df = spark.createDataFrame([(k, lang, bytearray(c)) for k, (lang, c, _) in enumerate(SNIPPETS)], "k int, lang string, c binary")
    got = {r["k"]: r["s"] for r in df.select("k", signals.detect(F.col("lang"), signals.read_head(F.col("c"))).alias("s")).collect()}
    assert [got[k] for k in range(len(SNIPPETS))] == [w for *_, w in SNIPPETS] == [detect(lang, c) for lang, c, _ in SNIPPETS]


# --- scanners ----------------------------------------------------------------------------------


@pytest.mark.parametrize("line, language, want", [
    ('x = "a#b"  # c', "python", 'x = "a#b"  '), ("a /* b */ c // d", "java", "a   c "), ("a /* b", "go", "a "), (r"x = /^https?:\/\//; // c", "javascript", r"x = /^https?:\/\//; "),
    ("a / b / c // d", "javascript", "a / b / c "), ("return /[/]/.test(x) // c", "javascript", "return /[/]/.test(x) "), ('s = "open // x', "java", 's = "open // x'), ("let a: &'a str; // b", "rust", "let a: &'a str; "),
])
def test_comments_are_cut(line, language, want):
    assert without_comment(line, language) == want


def test_star_lines():
    assert code_of(" * Returns", "java") == "* Returns" and code_of(" * Returns", "java", True) is None and code_of(" */ int x;", "java") == "int x;"
    assert code_of("    x = 1  # n", "python") == "    x = 1" and code_of("  ", "go") is None


RUST = b"use x;\n#[cfg(test)]\nmod tests {\n    use super::*;\n    #[test]\n    fn one() {\n        let c = '{';\n        assert_eq!(1, 1);\n    }\n    #[tokio::test]\n    async fn two() { assert!(true); }\n    fn helper() {}\n}\n#[cfg(test)]\nmod other;\nfn z() {}\n"
PYTHON = b'import x\n\nclass TestA:\n    @mark\n    @other(\n        1,\n    )\n    def test_one(\n        self,\n    ) -> None:\n        x = """\nnot indented\n"""\n        assert x\n\n    # comment\n    def helper(self):\n        pass\n\n    async def test_two(self):\n        assert 1 + \\\n  2\n\ndef test_top():\n    pass\n\n\nx = 1\n'
JAVA = b'class ATest {\n  @Test\n  @DisplayName("x")\n  void a() {\n    assertEquals(1, 1);\n  }\n  static class Inner {\n    @Test void b() { fail("x"); }\n  }\n}\n'
SCRIPT = b"describe('x', () => {\n  test('one', () => {\n    expect(1).toBe(1)\n  })\n  it('two', () => expect(2).toBe(2))\n  it.skip(`three`, () => { a })\n})\n"


def test_test_ranges():
    assert ranges_of_tests(RUST, "rust") == (FoundTest("tests::one", 5, 9), FoundTest("tests::two", 10, 11))
    assert ranges_of_tests(PYTHON, "python") == (FoundTest("TestA::test_one", 4, 14), FoundTest("TestA::test_two", 20, 22), FoundTest("test_top", 24, 25))
    assert ranges_of_tests(JAVA, "java") == (FoundTest("ATest#a", 2, 6), FoundTest("Inner#b", 8, 8))
    assert ranges_of_tests(SCRIPT, "javascript") == (FoundTest("one", 2, 4), FoundTest("two", 5, 5), FoundTest("three", 6, 6))
    assert ranges_of_tests(b'package x\nfunc TestA(t *testing.T) {\n\tt.Error("}")\n}\n', "go") == (FoundTest("TestA", 2, 4),)


def test_regions():
    assert inline_test_regions(RUST) == ((2, 13), (14, 15))
    assert comment_regions(b'/** doc\n * more\n */\nfn a() {}\n/* x /* nested */ still\n * y */ fn b() {}\nlet s = "/* no";\n', "rust") == ((2, 3), (6, 6))
    assert comment_regions(b"/* never\nclosed\n", "go") == ((2, 3),)


def test_scans_are_linear():
    began = time.perf_counter()
    without_comment("a/" * 100_000, "javascript")
    ranges_of_tests(b"".join(b"it('t%d', () => x)\n" % k for k in range(4000)), "javascript")
    assert time.perf_counter() - began < 5


def test_names_on_added_lines():
    assert defined_tests(["class TestX:", "    def test_a(self):", "        pass", "def test_b():"], "python") == {"TestX::test_a", "test_b"}
    assert defined_tests(["    def test_a(self):"], "python") == set() == defined_tests(["@Test", "void a() {"], "java")
    assert defined_tests(["class T {", "  @Test", "  void a() {"], "java") == {"T#a"}
    assert public_names(["export { a, b as c }", "export default x"], "javascript") == {"export a", "export c", "export default"}
    assert public_names(["pub async fn f()", "fn g()"], "rust") == {"pub fn f"} and public_names(["func (r *T) Do(", "type x int"], "go") == {"func Do"}


def test_patches():
    text = "@@ -1,4 +1,5 @@\n a\n-b\n+B\n+C\n c\n d\n@@ -10,2 +11,1 @@ ctx\n x\n-y\n\\ No newline at end of file"
    assert hunks_from_unified(text) == (Hunk(2, 2, ("b",), ("B", "C")), Hunk(11, 11, ("y",), ()))
    assert hunks_from_unified("@@ -0,0 +1,2 @@\n+a\n+b") == (Hunk(0, 1, (), ("a", "b")),)
    assert hunks_from_unified("@@ -3,2 +3,3 @@\n a\n+n\n b") == (Hunk(3, 4, (), ("n",)),)
    for bad in ("x", "@@ -1 +1 @@\n-a", "@@ -1 +1 @@\n-a\n+b\n+c", "@@ -1,2 +1,2 @@\n?a"):
        with pytest.raises(PatchError):
            hunks_from_unified(bad)
    block = b"diff --git a/x b/x\nindex 1..2\n--- a/x\n+++ b/x\n@@ -1 +1,2 @@\n-a\n+b\n+c\n\\ No newline at end of file\ndiff --git a/y b/y\nBinary files a/y and b/y differ\n"
    assert parse_patch(block) == [FilePatch((Hunk(1, 1, ("a",), ("b", "c")),)), FilePatch((), True)]
    switch = b"diff --git a/x b/x\ndeleted file mode 100644\n--- a/x\n+++ /dev/null\n@@ -1 +0,0 @@\n-a\ndiff --git a/x b/x\nnew file mode 120000\n--- /dev/null\n+++ b/x\n@@ -0,0 +1 @@\n+b\n"
    assert len(parse_patch(switch)) == 1 and parse_patch(switch)[0].added == 1


def test_measurement():
    edit = FilePatch((Hunk(1, 1, ("def f(x):", "    return 1"), ("def f(x):", "    return 2", "    assert x")),))
    got = measure.analyze(edit, "python")
    assert (got["code_hunks"], got["code_added"], got["code_deleted"], got["asserts"], got["api"]) == (1, 3, 2, 1, ["def f"])
    moved = FilePatch((Hunk(1, 1, ("  assert a",), ("assert a", "# x")),))
    assert measure.analyze(moved, "python")["asserts"] == 0 and measure.analyze(FilePatch((Hunk(1, 1, ("x();",), ("  x(); // y",)),)), "java")["code_hunks"] == 0
    assert measure.analyze(edit, None)["code_hunks"] == 1
    inner = measure.analyze_versions(FilePatch((Hunk(7, 8, (), ("        assert_eq!(1, 1);",)),)), "rust", RUST, RUST)
    assert (inner["test_added"], inner["code_hunks"], inner["asserts"], inner["tests"]) == (1, 0, 1, ["tests::one"])


def test_measurement_columns(spark):
    df = spark.createDataFrame([("@@ -1 +1 @@\n-a = 1\n+a = 2", "python"), (None, "python")], "patch string, lang string")
    rows = df.select(measure.measured(measure.unified_hunks(F.col("patch")), F.col("lang")).alias("p")).collect()
    assert rows[0]["p"]["code_hunks"] == 1 and rows[1]["p"] is None
    tests = spark.createDataFrame([(bytearray(PYTHON), "python")], "c binary, lang string").select(measure.file_tests(F.col("c"), F.col("lang")).alias("t")).first()["t"]
    assert [t["name"] for t in tests] == ["TestA::test_one", "TestA::test_two", "test_top"]


def test_diffs_are_measured_in_one_pass(spark):
    """The same rows as by way of a column of hunks, nulls and other languages included, with one Python step and no hunks in the plan."""
    said = ["@@ -1,2 +1,3 @@\n-    assert f(1)\n x\n+    assert f(2)\n+    assert g(é)\n@@ -9,1 +10,0 @@\n-def gone():\n", "@@ -1,1 +1,2 @@\n-a\n+/* b\n+ * c\n", "", None]
    rows = spark.createDataFrame([(n, t, lang) for n, (t, lang) in enumerate((t, lang) for t in said for lang in ("python", "rust", "javascript", None))], "n int, diff string, lang string")
    found = rows.select("n", measure.measured_diff(F.col("diff"), F.col("lang")).alias("p"))
    assert found.sort("n").collect() == rows.select("n", measure.measured(measure.unified_hunks(F.col("diff")), F.col("lang")).alias("p")).sort("n").collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "old_start" not in plan
