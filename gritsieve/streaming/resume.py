"""Incremental runs: what is new since a watermark, as batch joins and as a stream.

Nothing is dropped for being late: the exact set of evaluated keys decides, not a bound on lateness.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from gritsieve.streaming.key_index import KeyIndex


@dataclass(frozen=True)
class Resume:
    """How a walk resumed."""

    mode: str
    previous: str | None
    watermark: str | None
    skipped: int
    note: str | None = None


def mode(previous: str | None, full: bool, walked: int) -> str:
    """first, full, resumed or up-to-date."""
    return "first" if previous is None else "full" if full else "resumed" if walked else "up-to-date"


def unseen(rows: DataFrame, seen: DataFrame, key: str = "sha") -> DataFrame:
    """Rows whose key was not evaluated before."""
    return rows.join(seen.select(key).distinct(), key, "left_anti").select(*rows.columns)


def stream_unseen(source: DataFrame, keys: list[str], handle: Callable[[DataFrame, int], None], checkpoint: str, walked: str):
    """Run ``handle`` on the unseen rows of each micro-batch of a stream; returns the query.

    The keys of a batch are the increment of its number in the index at ``walked``, written before the handler's
    result counts as done: a batch that is replayed is compared with all others only, so it gives the same rows again.
    """

    def step(batch: DataFrame, number: int) -> None:
        index = KeyIndex(batch.sparkSession, walked, keys)
        rows = index.unseen(batch.dropDuplicates(keys), number).persist()
        handle(rows, number)
        index.add(rows, number)
        rows.unpersist()
        index.compact()

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watermarked_counts(events: DataFrame, delay: str = "1 hour", window: str = "1 hour", ts: str = "ts", key: str = "event_type") -> DataFrame:
    """Counts by window with a bound on lateness, for those who want one."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, window), key).agg(F.count("*").alias("n"))


def position(spark: SparkSession, rows: DataFrame, column: str, previous: str | None) -> str | None:
    """The later of the last position and the newest of these rows."""
    newest = rows.agg(F.max(column)).first()[0]
    return max([p for p in (previous, newest) if p is not None], default=None)
