"""Importance resampling towards a target distribution, by CRC combination algebra.

Every run of 1 to ``grams`` consecutive words is a feature, hashed to a bucket by the CRC-32 of its
bytes. The CRC of a word is computed once. As a CRC is linear over GF(2), that of two joined strings is
the CRC of the first, moved on by the length of the second with a 32 by 32 bit matrix, plus that of the
second: runs of words get their CRCs from those of their words, and no run is ever put together as a string.

The corpus is read twice. The first pass counts features by bucket: a task sends one sparse histogram,
so at most ``buckets`` rows of each task are shuffled. The gain of each bucket is a native column over the
joined counts; at most ``buckets`` gains go through the driver and are broadcast, which is their bound. The
second pass weighs every document with them. The draw is a Gumbel top-k: a hash of the id gives each
document its noise, and narrow rows are ranked by ranges, so no task sees all of them.

Defined results: a null or wordless text has no features, the weight 0 and no rank; a null ``doc_id``
draws as the text ``null`` and comes last among ties; rows that repeat an id draw alike and are ranked one
by one; an empty corpus gives no rows; an empty target is no target: all its counts are 0; other
columns are ignored by the report and returned unchanged by ``resample``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gritsieve.llm.arrow import raw, spare, table
from gritsieve.llm.decontaminate import FOLD
from gritsieve.llm.words import Memo
from gritsieve.operators.places import placed
from gritsieve.scratch import Scratch

GRAMS = 1
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Smoothing of both counts: each bucket counts one more, so all together ``buckets`` more.
POLYNOMIAL = 0xEDB88320  # of CRC-32, bits reversed


def _compose(outer: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """The matrix of ``outer`` after ``inner``; a matrix is the images of the 32 unit vectors."""
    bits = (inner[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
    return np.bitwise_xor.reduce(bits * outer[None, :], axis=1)


def shift_matrix(n_bytes: int) -> np.ndarray:
    """The GF(2) matrix that moves a CRC on over ``n_bytes`` zero bytes, by repeated squaring."""
    power = np.array([POLYNOMIAL] + [1 << k for k in range(31)], dtype=np.uint32)  # one bit
    for _ in range(3):
        power = _compose(power, power)  # one byte
    result = np.uint32(1) << np.arange(32, dtype=np.uint32)
    while n_bytes:
        if n_bytes & 1:
            result = _compose(power, result)
        n_bytes >>= 1
        if n_bytes:
            power = _compose(power, power)
    return result


def _bytewise(matrix: np.ndarray) -> np.ndarray:
    """A matrix as four tables of 256 images, one for each byte of its argument."""
    value = np.arange(256, dtype=np.uint32)
    bits = (value[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32(1)
    return np.stack([np.bitwise_xor.reduce(bits * matrix[None, 8 * k : 8 * k + 8], axis=1) for k in range(4)])


class Grams:
    """Buckets of the features of texts. Holds CRCs of words and shift tables by length, both bounded."""

    TABLES = 1024

    def __init__(self, grams: int, buckets: int) -> None:
        self.grams, self.buckets = grams, buckets
        self._crc = Memo(lambda w: zlib.crc32(w) << 32 | len(w))
        self._tables: dict[int, np.ndarray] = {}

    def _table(self, length: int) -> np.ndarray:
        if length not in self._tables:
            if len(self._tables) >= self.TABLES:
                self._tables.clear()
            self._tables[length] = _bytewise(shift_matrix(length))
        return self._tables[length]

    def _moved(self, crc: np.ndarray, by: np.ndarray) -> np.ndarray:
        """Each CRC moved on by its number of bytes."""
        lengths, which = np.unique(by, return_inverse=True)
        tables = np.stack([self._table(int(n)) for n in lengths]) if len(lengths) else np.zeros((0, 4, 256), np.uint32)
        moved = tables[which, 0, crc & np.uint32(255)]
        for k in (1, 2, 3):
            moved ^= tables[which, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
        return moved

    def crcs(self, text: bytes | None) -> list[np.ndarray]:
        """For k = 1, 2, ...: the CRCs of all runs of k words, joined by a space."""
        packed = self._crc.array((text or b"").translate(FOLD))
        crc, length = (packed >> np.uint64(32)).astype(np.uint32), (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
        found = [crc]
        if self.grams > 1:
            spaced = self._moved(np.full(len(crc), zlib.crc32(b" "), dtype=np.uint32), length) ^ crc  # of a space and the word
        for k in range(1, self.grams):
            if len(crc) <= k:
                break
            found.append(self._moved(found[-1][:-1], length[k:] + 1) ^ spaced[k:])
        return found

    def of(self, text: bytes | None) -> tuple[int, np.ndarray]:
        """The number of words, and the bucket of every feature."""
        found = self.crcs(text)
        return len(found[0]), np.concatenate(found) % np.uint32(self.buckets)


def histogram(texts: DataFrame, grams: int, buckets: int) -> DataFrame:
    """(bucket, n) of all features of all texts; one sparse histogram leaves each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, of = np.zeros(buckets, dtype=np.int64), Grams(grams, buckets)
        for batch in batches:
            for text in raw(batch, "text"):
                total += np.bincount(of.of(text)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield table({"bucket": (held, pa.int64()), "n": (total[held], pa.int64())})

    return texts.select(texts["text"].alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for all buckets: how much likelier its features are in the target, in thousandths of a nat."""
    scratch = Scratch(docs.sparkSession, "importance")
    own, wanted = (scratch.stash(histogram(x, grams, buckets), name) for x, name in ((docs, "own"), (target, "target")))
    total = lambda counts: counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double")).first()[0]
    ratio = (F.coalesce("t", F.lit(0)) + 1).cast("double") * F.lit(total(own) + buckets) / ((F.coalesce("s", F.lit(0)) + 1).cast("double") * F.lit(total(wanted) + buckets))
    counts = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(own.withColumnRenamed("n", "s"), "bucket", "left").join(wanted.withColumnRenamed("n", "t"), "bucket", "left")
    return counts.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def _weighed(docs: DataFrame, gains: np.ndarray, grams: int, keys: list) -> DataFrame:
    """(doc_id, *keys, n_words, n_features, weight) of every document."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gains), len(gains)
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *keys, docs["text"].alias("text"))
    kept = [(f.name, f.dataType.simpleString()) for f in slim.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Grams(grams, buckets)
        for batch in batches:
            found = [of.of(text) for text in raw(batch, "text")]
            sizes, sums = [len(b) for _, b in found], [int(shared.value[b].sum()) for _, b in found]
            yield table({name: (batch.column(name), pa.int64()) for name, _ in kept} | {
                "n_words": ([n for n, _ in found], pa.int64()), "n_features": (sizes, pa.int64()), "weight": ([s // n if n else 0 for s, n in zip(sums, sizes)], pa.int64()),
            })

    return slim.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in kept) + ", n_words long, n_features long, weight long")


def _ranked(docs: DataFrame, target: DataFrame, grams: int, buckets: int, min_words: int, percent: int, seed: str, *keys) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "importance-ranks")
    gains = np.zeros(buckets, dtype=np.int64)
    for row in bucket_gains(docs, target, grams, buckets).collect():  # one row for each bucket
        gains[row["bucket"]] = row["gain"]
    rows = scratch.stash(_weighed(docs, gains, grams, list(keys)), "weighed")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = rows.withColumn("score", F.col("weight") + noise)
    drawn = percent * rows.where(F.col("n_words") >= min_words).count() // 100
    able = placed(rows.where(F.col("n_words") >= min_words), [], [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")], "place")
    ranked = able.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")).cast("long")).drop("place")
    return ranked.unionByName(rows.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def importance_report(
    docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: str = SEED
) -> DataFrame:
    """For each document: its features, weight, score with noise, and its rank where it is drawn."""
    return _ranked(docs, target, grams, buckets, min_words, percent, seed).select("doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """The documents that are drawn, with all their columns, in no order.

    Of rows that repeat an id and a text, all are kept if any is drawn.
    """
    of, none, row = spare(docs.columns, "id", "none", "row")
    ranked = _ranked(docs, target, grams, buckets, min_words, percent, seed, F.xxhash64(docs["text"]).alias("row"))
    heads = ranked.where(F.col("rank").isNotNull()).select(F.coalesce("doc_id", F.lit(0)).alias(of), F.col("doc_id").isNull().alias(none), F.col("row").alias(row)).distinct()
    own = docs["doc_id"].cast("long")
    keyed = docs.withColumns({of: F.coalesce(own, F.lit(0)), none: own.isNull(), row: F.xxhash64(docs["text"])})
    return keyed.join(heads, [of, none, row], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
