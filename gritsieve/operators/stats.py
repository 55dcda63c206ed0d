"""Measurements of a commit: one aggregate over its classified files.

Every measure of the filter, the score and the difficulty comes from a single ``groupBy``: partial
aggregates fold a commit's files where they are read, and one row for each commit is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gritsieve.functions.text import patch_hash
from gritsieve.schema import CATEGORIES


def explode_files(commits: DataFrame, keys: Sequence[str] = ("repo", "sha")) -> DataFrame:
    """One row for each changed file: the keys, ``pos_in_commit`` and the fields of the file."""
    return commits.select(*keys, F.posexplode("files").alias("pos_in_commit", "file")).select(*keys, "pos_in_commit", "file.*")


def _sum(value: Column, where: Column | None = None) -> Column:
    return F.coalesce(F.sum(F.when(where, value) if where is not None else value), F.lit(0)).cast("long")


def _count(where: Column) -> Column:
    return F.count_if(where).cast("long")


def diff_stats(files: DataFrame, keys: Sequence[str] = ("repo", "sha"), lists: bool = True, api: bool | None = True) -> DataFrame:
    """Per-commit aggregates of classified files; null measures are unknown ones.

    ``lists`` adds the arrays (paths, tests, fingerprints), ``api`` the public names; tables without
    patch measurements can do without them. With an ``api`` of None there is only ``any_api``, whether a
    name is known: without lists all aggregates are fixed in size and compiled.
    """
    added, deleted = F.coalesce("added", F.lit(0)), F.coalesce("deleted", F.lit(0))
    binary = F.col("added").isNull() | F.col("deleted").isNull()
    measured = F.col("patch").isNotNull()
    inline_added, inline_deleted = F.coalesce("patch.test_added", F.lit(0)), F.coalesce("patch.test_deleted", F.lit(0))
    outside = added + deleted - inline_added - inline_deleted
    source, test = F.col("category") == "source", F.col("category") == "test"
    both = source | test
    inline = source & (F.coalesce(F.array_contains("signals", "rust-tests-added"), F.lit(False)) | (inline_added > 0))
    tests = test | inline
    patched = measured | binary
    code = F.when(measured, F.col("patch.code_hunks")).otherwise(outside)
    every = lambda where: F.coalesce(F.min(F.when(where, patched)), F.lit(True))
    aggregates = [F.count("*").cast("long").alias("n_files")]
    aggregates += [_count(F.col("category") == c).alias(f"n_{c}") for c in CATEGORIES]
    aggregates += [
        _sum(added + deleted, both).alias("changed_lines"),
        _sum(added - inline_added, source).alias("source_added"),
        _sum(deleted - inline_deleted, source).alias("source_deleted"),
        (_sum(added, test) + _sum(inline_added, source)).alias("test_added"),
        (_sum(deleted, test) + _sum(inline_deleted, source)).alias("test_deleted"),
        _count(source & (outside > 0)).alias("n_source_changed"),
        every(source).alias("source_patched"),
        _count(source & (code > 0)).alias("n_code_files"),
        _count(inline).alias("n_inline_test"),
        _sum(F.col("patch.code_hunks"), source & measured).alias("all_code_hunks"),
        _sum(F.col("patch.code_added") + F.col("patch.code_deleted"), source & measured).alias("all_code_lines"),
        _sum(F.col("patch.asserts"), tests & measured).alias("all_asserts"),
        every(tests).alias("tests_patched"),
    ]
    if api:
        aggregates.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(source & measured, F.col("patch.api")))))).alias("all_api"))
    if api is None:
        aggregates.append(F.coalesce(F.max(source & measured & (F.size("patch.api") > 0)), F.lit(False)).alias("some_api"))
    if lists:
        hashed = both & ~binary
        aggregates += [
            F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(tests & measured, F.transform("patch.tests", lambda t: F.concat("path", F.lit("::"), t))))))).alias("fail_to_pass"),
            F.array_sort(F.flatten(F.collect_list(F.when(hashed, F.col("patch.hunk_hashes"))))).alias("all_hunks"),
            F.coalesce(F.max(F.when(hashed, F.col("patch.hunk_hashes").isNull())), F.lit(False)).alias("hunks_unknown"),
            F.transform(F.array_sort(F.collect_list(F.when(source, F.struct("pos_in_commit", "path")))), lambda x: x["path"]).alias("source_paths"),
            F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("pos_in_commit", "path")))), lambda x: x["path"]).alias("test_paths"),
        ]
    out = files.groupBy(*keys).agg(*aggregates).withColumns({
        "code_hunks": F.when(F.col("source_patched"), F.col("all_code_hunks")),
        "code_lines": F.when(F.col("source_patched"), F.col("all_code_lines")),
        "assertions": F.when(F.col("tests_patched"), F.col("all_asserts")),
    })
    if api:
        out = out.withColumn("public_api", F.when(F.col("source_patched"), F.col("all_api"))).drop("all_api")
    if api is None:
        out = out.withColumn("any_api", F.col("source_patched") & F.col("some_api")).drop("some_api")
    if lists:
        out = out.withColumns({
            "fingerprint": F.when(~F.col("hunks_unknown") & (F.size("all_hunks") > 0), F.struct(patch_hash(F.col("all_hunks")).alias("patch"), F.col("all_hunks").alias("hunks"))),
        }).drop("all_hunks", "hunks_unknown")
    return out.drop("all_code_hunks", "all_code_lines", "all_asserts")
