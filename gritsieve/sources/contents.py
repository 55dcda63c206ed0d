"""Content signals of single files in plain Python, for readers, and of working trees as a scan."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from gritsieve.functions import signals as sg
from gritsieve.functions.text import language_of


def _python(pattern: str, *flags: int) -> re.Pattern:
    """One of the Java expressions of the signals, without its inline flags."""
    bits = 0
    for flag in flags:
        bits |= flag
    return re.compile(re.sub(r"^\(\?[A-Za-z]+\)", "", pattern), bits)


_OPENING = _python(sg._OPENING)
_MARK = _python(sg._MARK, re.IGNORECASE)
_CLAIM = _python(sg._CLAIM, re.IGNORECASE)
_INLINE = _python(sg._INLINE_TESTS, re.MULTILINE)
_TEST = _python(sg._TEST_ATTRIBUTE, re.MULTILINE)


def _text(content: bytes) -> str:
    return content[: sg.MAX_CONTENT].decode("utf-8", "replace")


def test_count(content: bytes) -> int:
    return len(_TEST.findall(_text(content)))


def detect(language: str | None, content: bytes) -> list[str]:
    """The sorted signals of a file's contents."""
    if language is None:
        return []
    text, found = _text(content), []
    for line in text.splitlines()[: sg.HEADER_LINES]:
        opening = _OPENING.match(line)
        if opening and (_MARK.search(line) or _CLAIM.match(line, opening.end())):
            found.append("generated-header")
            break
    sample = text[: sg.SAMPLE]
    if language == "javascript" and len(sample) >= sg.MINIFIED_LEAST and len(sample) >= sg.MINIFIED_MEAN * (sample.count("\n") + 1):
        found.append("minified")
    if language == "rust" and _INLINE.search(text):
        found.append("rust-inline-tests")
    return found


def working_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, signals) of the files below a folder; only the head of each file is looked at."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.lit(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/")
    path = F.element_at(F.split("path", base, 2), 2)
    return files.select(path.alias("path"), sg.detect(language_of(path), sg.read_head(F.col("content"))).alias("signals"))
