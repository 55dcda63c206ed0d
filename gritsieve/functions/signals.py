"""Content signals: what a file's text tells that its path cannot. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gritsieve.functions.text import split_lines

#: Every signal and its meaning (fixed values).
SIGNALS = {
    "generated-header": "a comment in the first lines says this file is generated",
    "minified": "JavaScript with an average line length of at least 200 characters",
    "rust-inline-tests": "Rust source with an in-file #[cfg(test)] module",
    "rust-tests-added": "a Rust source file gained #[test] functions in this commit",
}

#: Bytes of a file that are looked at, and the bounds of the tests on them (fixed values).
MAX_CONTENT = 1 << 20
HEADER_LINES = 30
SAMPLE = 64 * 1024
MINIFIED_LEAST, MINIFIED_MEAN = 512, 200

_OPENING = r"\A\s*(?://+!?|/\*+!?|\*+|#+!?|\"\"\"|''')\s*"
_MARK = r"(?iUd)@generated\b|\bgenerated\b.*\bdo not (?:edit|modify)\b|\bdo not (?:edit|modify)\b.*\bgenerated\b"
_CLAIM = (
    r"(?:this\s+(?:\w+\s+)?(?:file|code|module|class|package|source|header)\s+(?:is|was|has\s+been)\s+(?:auto-?|automatically\s+|machine[- ])?generated"
    r"|(?:this\s+is\s+)?(?:an?\s+)?(?:auto-?generated|automatically\s+generated|machine[- ]generated))\b"
)
_INLINE_TESTS = r"(?mUd)^\s*#\[cfg\((?:all\()?test\b"
_TEST_ATTRIBUTE = r"(?mUd)^\s*#\[(?:\w+::)*test(?:\]|\()"


def has_generated_header(text: Column) -> Column:
    """Whether one of the first lines is a comment that marks the file as generated."""
    return F.exists(F.slice(split_lines(text), 1, HEADER_LINES), lambda x: (x.rlike(f"(?U){_OPENING}") & x.rlike(_MARK)) | x.rlike(f"(?iU){_OPENING}{_CLAIM}"))


def is_minified(text: Column) -> Column:
    sample = F.substring(text, 1, SAMPLE)
    lines = F.length(sample) - F.length(F.replace(sample, F.lit("\n"), F.lit(""))) + 1
    return (F.length(sample) >= MINIFIED_LEAST) & (F.length(sample) >= MINIFIED_MEAN * lines)


def has_inline_tests(text: Column) -> Column:
    return text.rlike(_INLINE_TESTS)


def count_test_functions(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_TEST_ATTRIBUTE))


def tests_added(content: Column, previous: Column) -> Column:
    """Whether a file gained test functions over its previous version (null: new)."""
    return count_test_functions(content) > F.coalesce(count_test_functions(previous), F.lit(0))


def read_head(content: Column) -> Column:
    """The part of a binary column that is looked at, as text."""
    return F.decode(F.substring(content, 1, MAX_CONTENT), "UTF-8")


def detect(language: Column, text: Column) -> Column:
    """The sorted signals of one version of a file; none outside the known languages."""
    found = F.array(
        F.when(has_generated_header(text), "generated-header"),
        F.when((language == "javascript") & is_minified(text), "minified"),
        F.when((language == "rust") & has_inline_tests(text), "rust-inline-tests"),
    )
    return F.when(language.isNull() | text.isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(found))
