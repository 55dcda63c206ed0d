"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, mixing.

Every stage takes whatever its predecessor kept, whole texts of any length included. All stages but the
last return the columns of their input, extra ones too, whatever their names are; an empty table passes
as an empty table, and without a benchmark nothing is contaminated. What each does with nulls, empty
texts, ties and repeated rows stands at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gritsieve.llm.decontaminate import decontaminate
from gritsieve.llm.line_dedup import dedup_lines
from gritsieve.llm.mixing import mix
from gritsieve.llm.quality import quality_filter
from gritsieve.llm.simhash import dedup
from gritsieve.scratch import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counting rules and the compression bands.

    A null, empty or short text (fewer than 50 words) is rejected; repeated rows are judged alike.
    """
    return quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more documents share.

    All rows stay: a null text stays null, and a document that loses all its lines has an empty text. Repeated
    rows and rows without an id count as documents of their own; ``n_chars`` follows the text.
    """
    return dedup_lines(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    The smallest id stays, a null one only in a group without ids; of rows that repeat an id, one. Texts without
    words, null ones included, are one group, so one of them stays.
    """
    return dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark to speak of.

    A text without words, or null, is clean; items without words are passed over; repeated rows are judged alike.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate says, with a ``copy_no``.

    A null text has no words but is drawn like any other; a null source is a source of its own; a null id draws
    as the text ``null``, and rows that repeat an id draw alike. An input ``copy_no`` is replaced.
    """
    return mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: zstandard ratios and 64-bit hashes of the kind used here cannot be expressed in DuckDB SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each but the last is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = scratch.stash(docs, name)
        if 1 <= number < len(STAGES) - 1:
            scratch.drop(STAGES[number - 1][0])
    return docs
