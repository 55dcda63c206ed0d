"""Mixing sources to target weights.

Tokens are summed for each source, targets follow by weight under a cap, and every document is taken
``floor(rate)`` times and once more with the probability that the fraction of the rate gives. The
draw is a hash of seed, trial and ``doc_id``, so it needs no state and reruns agree. A source of few or
very unequal documents may miss its target by chance in one trial: each source draws by that trial, of
``TRIALS``, whose words come nearest to its target.

Words are counted in one pass, which leaves narrow rows. The sizes of the sources and the words of the
trials are summed with map-side aggregates; the rates are written to the shared folder, so the
planner knows how small the table is before it chooses the join; where it is too large to broadcast,
the join is by sort and merge and a hot source is split at run time.

Defined results: a null text has size 0; a null source is a source of its own, last in order; the
empty string is an ordinary source; a null ``doc_id`` draws as the text ``null``; rows that repeat a
``doc_id`` draw alike; an empty table gives an empty result; a corpus without words has targets of 0
and takes nothing; other columns are ignored by the plan and returned unchanged by ``mix``, whatever their
names are, save an input ``copy_no``, which the number of the copy replaces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gritsieve.llm.arrow import spare
from gritsieve.scratch import Scratch

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_RATE = 2
SEED = "mix-1"
#: Trials that a source chooses its draw from.
TRIALS = 32


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share_percent: int = SHARE_PERCENT, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Resharing the excess until no target is above its cap has one fixed point: in ascending order of
    cap / weight, sources are capped as long as an equal share by weight would reach their cap. One
    window in that order finds it. The windows run over one row for each source.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", weight.cast("long")).withColumn("cap", max_rate * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("total", F.sum("source_size").over(whole) * share_percent / F.lit(100.0))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("full", F.col("cap") / F.col("w") <= (F.col("total") - F.col("cap_before")) / F.col("w_left"))
    )
    per = per.withColumn("open", F.coalesce(F.max(F.when(~F.col("full"), 1)).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) == 1)
    per = per.withColumn("cap_sum", F.coalesce(F.sum(F.when(~F.col("open"), F.col("cap"))).over(whole), F.lit(0))).withColumn("w_sum", F.sum(F.when(F.col("open"), F.col("w"))).over(whole))
    target = F.when(~F.col("open"), F.col("cap").cast("double")).otherwise(F.col("w") * (F.col("total") - F.col("cap_sum")) / F.col("w_sum"))
    return per.select("source", "source_size", target.alias("target"))


def draw(doc_id: Column, number: Column | int, seed: str = SEED) -> Column:
    """A number in [0, 1) from 32 bits of a hash of seed, the number of the trial and id."""
    number = F.lit(number) if isinstance(number, int) else number
    digest = F.md5(F.concat(F.lit(f"{seed}:"), number.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_rates(slim: DataFrame, trials: int = TRIALS, seed: str = SEED, **options) -> DataFrame:
    """(source, source_size, target, whole, fraction, trial): the rate of each source in two parts, and the trial to draw by.

    ``slim`` holds (doc_id, source, size). Each trial is one hashed draw of all documents. Their sums are partial
    aggregates over narrow rows, ``trials`` rows for each source; the trial nearest to the target wins, the first of equals.
    """
    targets = source_targets(slim.select("source", "size"), **options)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = targets.withColumn("whole", F.floor(rate)).withColumn("fraction", rate - F.floor(rate))
    tried = (
        slim.withColumnRenamed("source", "of").join(rates.select("source", "fraction"), F.col("of").eqNullSafe(F.col("source")))
        .select("source", "fraction", "size", "doc_id", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
        .groupBy("source", "trial").agg(F.sum(F.when(draw(F.col("doc_id"), F.col("trial"), seed) < F.col("fraction"), F.col("size")).otherwise(F.lit(0))).alias("drawn"))
    )
    off = F.abs(F.col("drawn") - (F.col("target") - F.col("whole") * F.col("source_size")))
    return (
        tried.withColumnRenamed("source", "of").join(rates, F.col("of").eqNullSafe(F.col("source")))
        .groupBy("source").agg(*[F.first(c).alias(c) for c in ("source_size", "target", "whole", "fraction")], F.min_by("trial", F.struct(off, "trial")).alias("trial"))
    )


def _sized(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, source, size) of every document, from the only pass over the texts; narrow rows in the shared folder."""
    slim = docs.select(docs["doc_id"].alias("doc_id"), docs["source"].cast("string").alias("source"), n_words(docs["text"]).alias("size"))
    return scratch.stash(slim, "sizes")


def _copies(rows: DataFrame, rates: DataFrame, of: str, copies: str, seed: str) -> DataFrame:
    """``rows`` with their source's rates in the struct ``of`` and the number of their copies."""
    packed = rates.select(F.struct(*rates.columns).alias(of))
    drawn = draw(rows["doc_id"], F.col(f"{of}.trial"), seed) < F.col(f"{of}.fraction")
    joined = rows.join(packed, rows["source"].cast("string").eqNullSafe(F.col(f"{of}.source")), "left")
    return joined.withColumn(copies, F.col(f"{of}.whole") + drawn.cast("long"))


def mix_report(docs: DataFrame, trials: int = TRIALS, seed: str = SEED, **options) -> DataFrame:
    """For each document: its size, its source's size and target, and the words that the mix takes of it."""
    scratch = Scratch(docs.sparkSession, "mix-report")
    slim = _sized(docs, scratch)
    rates = scratch.stash(source_rates(slim, trials, seed, **options), "rates")
    rows = _copies(slim, rates, "of", "copies", seed)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "of.source_size", "of.target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame, trials: int = TRIALS, seed: str = SEED, **options) -> DataFrame:
    """The mixture: every document as often as it is taken, with all its columns and a ``copy_no`` from 1."""
    scratch = Scratch(docs.sparkSession, "mix")
    rates = scratch.stash(source_rates(_sized(docs, scratch), trials, seed, **options), "rates")
    scratch.drop("sizes")
    of, copies = spare(docs.columns, "of", "copies")
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "copy_no"]
    rows = _copies(docs, rates, of, copies, seed)
    return rows.where(F.col(copies) > 0).select(*keep, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias("copy_no"))
