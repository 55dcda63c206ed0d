"""Filter, score, difficulty and rank: CASE expressions and two linear models over the measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gritsieve.functions.text import fix_keyword, instant, linked_reference, plural, subject
from gritsieve.operators.places import placed
from gritsieve.schema import BANDS, REASONS
from gritsieve.settings import Settings

NO_PATCH = "unknown: no patch data"

#: Name, value, weight and detail of a feature.
Part = tuple[str, Column, float, Column | None]


def reject_reason(settings: Settings = Settings()) -> Column:
    """The first reason that holds, or null for a candidate. Missing measures mean no files."""
    n = lambda name: F.coalesce(name, F.lit(0))
    too_large = (n("changed_lines") > settings.max_lines) | (n("n_source") > settings.max_source_files)
    checks = {
        "empty": n("n_files") == 0,
        "docs-only": n("n_docs") == n("n_files"),
        "generated-only": n("n_generated") + n("n_vendored") == n("n_files"),
        "no-source": n("n_source") == 0,
        "source-unchanged": n("n_source_changed") == 0,
        "source-cosmetic": F.col("source_patched") & (n("n_code_files") == 0),
        "no-test": n("n_test") + n("n_inline_test") == 0,
        "oversize": too_large,
    }
    chain = F
    for reason in REASONS:
        chain = chain.when(checks[reason], F.lit(reason))
    return chain


def oversize_detail(settings: Settings = Settings()) -> Column:
    """Which limit an oversize commit breaks."""
    lines = F.concat(F.col("changed_lines").cast("string"), F.lit(f" source+test lines (max {settings.max_lines})"))
    sources = F.concat(F.col("n_source").cast("string"), F.lit(f" source files (max {settings.max_source_files})"))
    return F.concat_ws(", ", F.when(F.col("changed_lines") > settings.max_lines, lines), F.when(F.col("n_source") > settings.max_source_files, sources))


def _exact_round(value: Column) -> Column:
    """Python's rounding of the exact binary value, for weights and caps that can make ties."""

    @F.pandas_udf(T.DoubleType())
    def rounded(values):
        return values.map(lambda x: None if x is None else round(x, 4))

    return rounded(value)


def _rounding(settings: Settings):
    return (lambda x: F.round(x, 4)) if settings.plain else _exact_round


def _feature(name: str, value: Column, weight: float, detail: Column | None, rounded) -> Column:
    value, detail = rounded(value.cast("double")), F.lit(None).cast("string") if detail is None else detail
    return F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(float(weight)).alias("weight"), rounded(F.lit(float(weight)) * value).alias("contribution"), detail.alias("detail"))


def _listed(parts: Sequence[Part], settings: Settings) -> Column:
    return F.array(*[_feature(*part, _rounding(settings)) for part in parts])


def _capped(count: Column, cap: int) -> Column:
    return F.least(count, F.lit(cap)) / F.lit(float(cap))


def said(message: Column, pull: Column | None = None) -> Column:
    """What a message says: its reference and its fix word, each with value and detail."""
    return F.struct(linked_reference(message, pull).alias("reference"), fix_keyword(subject(message), pull["labels"] if pull is not None else None).alias("keyword"))


def _score_parts(settings: Settings, s: Column) -> list[Part]:
    """The score features in their fixed order; ``s`` is what the message says."""
    w, reference, keyword = settings.weights, s["reference"], s["keyword"]
    tests = F.concat(F.col("test_added").cast("string"), F.lit(f" test lines added (full value at {settings.test_lines_cap})"))
    tests = F.concat(tests, F.when(F.col("n_inline_test") > 0, F.concat(F.lit(", in #[cfg(test)] of "), plural(F.col("n_inline_test"), "src file"))).otherwise(""))
    asserts = F.when(F.col("assertions").isNull(), NO_PATCH).otherwise(F.concat(plural(F.col("assertions"), "assertion line"), F.lit(f" added in tests (full value at {settings.assertions_cap})")))
    size = F.concat(F.col("changed_lines").cast("string"), F.lit(f" of at most {settings.max_lines} source+test lines changed"))
    return [
        ("small_diff", 1 - _capped(F.col("changed_lines"), settings.max_lines), w.small_diff, size),
        ("test_lines_added", _capped(F.col("test_added"), settings.test_lines_cap), w.test_lines_added, tests),
        ("added_assertions", _capped(F.coalesce("assertions", F.lit(0)), settings.assertions_cap), w.added_assertions, asserts),
        ("linked_reference", reference["value"], w.linked_reference, reference["detail"]),
        ("fix_keyword", keyword["value"], w.fix_keyword, keyword["detail"]),
        ("focused_source", F.try_divide(F.lit(1.0), F.col("n_source")), w.focused_source, F.concat(plural(F.col("n_source"), "source file"), F.lit(" changed"))),
    ]


def score_features(found: Column, settings: Settings = Settings()) -> Column:
    """The array of score features, in their fixed order; ``found`` is what is ``said`` in the message, a column."""
    return _listed(_score_parts(settings, found), settings)


def _difficulty_parts(settings: Settings, public_api: bool, any_api: Column | None) -> list[Part]:
    """The difficulty features in their fixed order."""
    w = settings.difficulty_weights
    files = F.col("n_source") + F.col("n_test")

    def known(count: str, word: str, tail: str) -> Column:
        return F.when(F.col(count).isNull(), NO_PATCH).otherwise(F.concat(plural(F.col(count), word), F.lit(tail)))

    names = F.col("public_api") if public_api else F.lit(None).cast("array<string>")
    more = F.when(F.size(names) > 3, F.concat(F.lit(" (+"), (F.size(names) - 3).cast("string"), F.lit(" more)"))).otherwise("")
    listed = F.when(names.isNull(), NO_PATCH).when(F.size(names) > 0, F.concat(F.array_join(F.slice(names, 1, 3), ", "), more)).otherwise("no public declaration changed")
    return [
        ("files", _capped(files, settings.files_cap), w.files, F.concat(plural(files, "source+test file"), F.lit(f" changed (full value at {settings.files_cap})"))),
        ("hunks", _capped(F.coalesce("code_hunks", F.lit(0)), settings.hunks_cap), w.hunks, known("code_hunks", "source code hunk", f" (full value at {settings.hunks_cap})")),
        ("lines", _capped(F.coalesce("code_lines", F.lit(0)), settings.lines_cap), w.lines, known("code_lines", "source code line", f" changed (full value at {settings.lines_cap})")),
        ("cross_file", _capped(F.greatest(F.col("n_code_files") - 1, F.lit(0)), settings.cross_file_cap), w.cross_file, F.concat(plural(F.col("n_code_files"), "source file"), F.lit(f" with code changes (full value at {settings.cross_file_cap + 1})"))),
        ("public_api", F.when(F.coalesce(F.size(names), F.lit(0)) > 0 if any_api is None else any_api, 1.0).otherwise(0.0), w.public_api, listed),
    ]


def difficulty_features(settings: Settings = Settings(), public_api: bool = True, any_api: Column | None = None) -> Column:
    """The array of difficulty features; unknown measures count as 0.

    ``any_api`` says whether there are public names where their list is not at hand.
    """
    return _listed(_difficulty_parts(settings, public_api, any_api), settings)


def total(features: str, settings: Settings = Settings()) -> Column:
    """The rounded sum of the contributions, in their order."""
    return _rounding(settings)(F.aggregate(F.col(features), F.lit(0.0), lambda a, f: a + f["contribution"]))


def _summed(parts: Sequence[Part], settings: Settings) -> Column:
    """What ``total`` gives of the listed features, without the list: compiled, and no arrays are made."""
    rounded, out = _rounding(settings), F.lit(0.0)
    for _, value, weight, _ in parts:
        out = out + rounded(F.lit(float(weight)) * rounded(value.cast("double")))
    return rounded(out)


def band(value: Column, settings: Settings = Settings()) -> Column:
    return F.when(value >= settings.hard_at, BANDS[2]).when(value >= settings.medium_at, BANDS[1]).otherwise(BANDS[0])


def rank_order(score: str = "score", instant_: str = "ts", sha: str = "sha") -> list[Column]:
    return [F.col(score).desc(), F.col(instant_).desc(), F.col(sha).asc()]


def evaluate(commits: DataFrame, stats: DataFrame, settings: Settings = Settings(), keys: Sequence[str] = ("repo", "sha"), details: bool = True) -> DataFrame:
    """``commits`` joined to their measures, with reason, features, score, difficulty, band and ``ts``.

    A left join keeps commits without files. Features are computed for candidates only. What the
    message says is a column, so what is made of it is compiled. Without ``details`` there are the sums only.
    """
    joined = commits.join(stats, list(keys), "left").withColumn("reason", reject_reason(settings))
    pull = F.col("pull_request") if "pull_request" in commits.columns else None
    lists, any_api = "public_api" in stats.columns, F.col("any_api") if "any_api" in stats.columns else None
    good = F.col("reason").isNull()
    out = joined.withColumn("__said", F.when(good, said(F.col("message"), pull)))
    if details:
        out = out.withColumns({"score_features": F.when(good, score_features(F.col("__said"), settings)), "difficulty_features": F.when(good, difficulty_features(settings, lists, any_api))})
        sums = {"score": total("score_features", settings), "difficulty": total("difficulty_features", settings)}
    else:
        sums = {"score": F.when(good, _summed(_score_parts(settings, F.col("__said")), settings)), "difficulty": F.when(good, _summed(_difficulty_parts(settings, lists, any_api), settings))}
    out = out.withColumns(sums | {"ts": instant(F.col("date"))})
    return out.withColumn("band", F.when(good, band(F.col("difficulty"), settings))).drop("__said")


def ranked(outcomes: DataFrame, partition: Sequence[str] = ("repo",)) -> DataFrame:
    """Candidates with their 1-based ``rank``: score, then newest, then sha. Pass the columns that are needed only."""
    return placed(outcomes.where("reason is null"), partition, rank_order(), "rank").withColumn("rank", F.col("rank").cast("int"))


def best(outcomes: DataFrame, top: int, partition: Sequence[str] = ("repo",)) -> DataFrame:
    """The ``top`` candidates of each group by rank; the planner cuts every partition to ``top`` rows ahead of the shuffle."""
    place = F.row_number().over(Window.partitionBy(*partition).orderBy(*rank_order()))
    return outcomes.where("reason is null").withColumn("rank", place).where(F.col("rank") <= top)
