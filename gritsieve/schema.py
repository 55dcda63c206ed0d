"""Row types of the engine and the fixed orders of its enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

#: Versions of the stored formats (fixed values).
RECORDING_VERSION = 1
EXPORT_VERSION = 6
FINGERPRINT_VERSION = 2
LEDGER_VERSION = 2

_STRINGS = T.ArrayType(T.StringType())

PATCH = T.StructType([
    T.StructField("hunks", T.IntegerType()),
    T.StructField("code_hunks", T.IntegerType()),
    T.StructField("code_added", T.IntegerType()),
    T.StructField("code_deleted", T.IntegerType()),
    T.StructField("test_added", T.IntegerType()),
    T.StructField("test_deleted", T.IntegerType()),
    T.StructField("asserts", T.IntegerType()),
    T.StructField("api", _STRINGS),
    T.StructField("hunk_hashes", _STRINGS),
    T.StructField("tests", _STRINGS),
])

FILE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("added", T.IntegerType()),
    T.StructField("deleted", T.IntegerType()),
    T.StructField("old_path", T.StringType()),
    T.StructField("signals", _STRINGS),
    T.StructField("patch", PATCH),
])

PULL_REQUEST = T.StructType([
    T.StructField("number", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("merged_at", T.StringType()),
    T.StructField("base_ref", T.StringType()),
    T.StructField("base_sha", T.StringType()),
    T.StructField("head_sha", T.StringType()),
    T.StructField("merge_commit_sha", T.StringType()),
    T.StructField("labels", _STRINGS),
    T.StructField("linked_issues", _STRINGS),
    T.StructField("commits", _STRINGS),
])

#: One commit or merged pull request; ``pos`` is its place in the walk, newest first.
COMMIT = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("pos", T.LongType()),
    T.StructField("sha", T.StringType()),
    T.StructField("parents", _STRINGS),
    T.StructField("date", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("files", T.ArrayType(FILE)),
    T.StructField("pull_request", PULL_REQUEST),
])

HUNK = T.StructType([
    T.StructField("old_start", T.IntegerType()),
    T.StructField("new_start", T.IntegerType()),
    T.StructField("deleted", _STRINGS),
    T.StructField("added", _STRINGS),
])

FEATURE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("contribution", T.DoubleType()),
    T.StructField("detail", T.StringType()),
])

CATEGORIES = ("source", "test", "docs", "config", "generated", "vendored", "other")
LANGUAGES = ("python", "rust", "javascript", "typescript", "go", "java")
BANDS = ("easy", "medium", "hard")
STATUSES = ("new", "duplicate", "overlap", "unknown")
OUTCOMES = ("new", "recorded", "internal", "collision", "unknown")

#: Reasons to reject a commit, in the order in which they are checked, with their meaning (fixed values).
REASONS = {
    "empty": "the commit changes no files",
    "docs-only": "every changed file is documentation",
    "generated-only": "every changed file is generated or vendored",
    "no-source": "no source file changed (only tests, config or other files)",
    "source-unchanged": "no source line changed outside inline tests (renames, mode changes, binary files)",
    "source-cosmetic": "source changes touch only comments, blank lines or (outside Python) indentation",
    "no-test": "no test file changed and no inline tests were added",
    "oversize": "more source+test lines or source files than the limits allow",
}
