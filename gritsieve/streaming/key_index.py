"""An index of the keys that were evaluated, kept in increments.

Each increment is a folder of keys by bucket of their hash, with a Bloom filter for each bucket. New keys are tested
against the filters first; only the (increment, bucket) folders that a filter points at are read. What was read is joined with
a bounded, counted broadcast of the new keys that it may hold, so old keys are neither shuffled nor read for
nothing, and an increment that shares no key with a batch costs its filters only.

An increment counts from when its filters are written, which comes last; writing the same number again replaces it, so a
batch that is repeated gives the same rows. Keys may be of several columns; nulls are values like others; repeated
keys count once; an empty increment is kept as such.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gritsieve.scratch import Scratch, remove

#: Bits of a filter for each of its keys, at least, and how many of them a key sets: one key in a hundred passes by chance.
BITS_PER_KEY = 10
HASHES = 7
#: New keys that are broadcast at once.
BLOCK = 1_000_000
#: Increments before they are merged into one.
MANY = 64


def _places(h: np.ndarray, n_bits: int) -> np.ndarray:
    """The bits of each hash: (keys, HASHES)."""
    h = h.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return ((h[:, None] + np.arange(HASHES, dtype=np.uint64)[None, :] * step[:, None]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(n_bits)


def bloom(h: np.ndarray) -> bytes:
    bits = np.zeros(max(64, BITS_PER_KEY * len(h) // 8 * 8 + 8), dtype=bool)
    bits[_places(h, len(bits)).ravel().astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def may_hold(bits: bytes, h: np.ndarray) -> np.ndarray:
    held = np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(bool)
    return held[_places(h, len(held)).astype(np.int64)].all(axis=1)


class KeyIndex:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))

    def _keyed(self, rows: DataFrame) -> DataFrame:
        """The distinct keys of rows with their hash and bucket."""
        h = F.xxhash64(*self.keys)
        return rows.select(*self.keys).distinct().withColumns({"__h": h, "__bucket": F.pmod(h, F.lit(self.buckets)).cast("int")})

    def increments(self) -> list[int]:
        """The numbers of the increments that are whole."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/filters")
        if not self._fs.exists(root):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(root)]
        return sorted(int(n) for n in names if n.lstrip("-").isdigit() and self._exists(f"{self.path}/filters/{n}/_SUCCESS"))

    def add(self, rows: DataFrame, number: int) -> None:
        """Keep the keys of ``rows`` as the increment ``number``."""
        remove(self.spark, f"{self.path}/filters/{number}")
        keyed = self._keyed(rows).repartition(self.buckets, "__bucket")
        keyed.write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.path}/keys/{number}")

        def build(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h = np.concatenate([b.column("__h").to_numpy() for b in batches])
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([bloom(h)], pa.binary())], ["bucket", "bits"])

        hashes = self.spark.read.schema("__h long, __bucket int").parquet(f"{self.path}/keys/{number}")
        hashes.groupBy("__bucket").applyInArrow(build, "bucket int, bits binary").write.mode("overwrite").parquet(f"{self.path}/filters/{number}")

    def _filters(self, numbers: list[int]) -> DataFrame:
        parts = [self.spark.read.schema("bucket int, bits binary").parquet(f"{self.path}/filters/{n}").withColumn("number", F.lit(n).cast("long")) for n in numbers]
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        return found

    def _pointed(self, asks: DataFrame, numbers: list[int]) -> DataFrame:
        """(h, bucket, number): which increments may hold which of the new hashes."""

        def test(key: tuple, asks: pa.Table, filters: pa.Table) -> pa.Table:
            h = asks.column("__h").to_numpy()
            found = [(h[may_hold(bits.as_py(), h)], n.as_py()) for bits, n in zip(filters.column("bits"), filters.column("number"))] if len(h) else []
            hashes = np.concatenate([np.zeros(0, np.int64), *[x for x, _ in found]])
            which = np.repeat(np.array([n for _, n in found], dtype=np.int64), [len(x) for x, _ in found])
            bucket = (asks if len(h) else filters).column("__bucket" if len(h) else "bucket")[0].as_py()
            return pa.table({"h": pa.array(hashes, pa.int64()), "bucket": pa.array([bucket] * len(hashes), pa.int32()), "number": pa.array(which, pa.int64())})

        return asks.select("__h", "__bucket").groupBy("__bucket").cogroup(self._filters(numbers).groupBy("bucket")).applyInArrow(test, "h long, bucket int, number long")

    def _found(self, folders: list[str], asks: DataFrame, same: Column) -> DataFrame:
        """The keys of ``asks``, which are few enough to broadcast, that the folders hold."""
        old = self.spark.read.schema(asks.select(*self.keys).schema).parquet(*folders)
        return old.select(*[F.col(k).alias(f"__old_{k}") for k in self.keys]).join(F.broadcast(asks.select(*self.keys)), same).select(*self.keys).distinct()

    @staticmethod
    def _turns(counts: dict[int, int]) -> list[tuple[list[int], int]]:
        """(buckets, parts): buckets whose new keys are broadcast together, or one bucket in several parts."""
        turns, held = [], 0
        for bucket, n in sorted(counts.items()):
            if n > BLOCK:
                turns.append(([bucket], -(-n // BLOCK)))
                held = BLOCK
            elif turns and held + n <= BLOCK:
                turns[-1][0].append(bucket)
                held += n
            else:
                turns.append(([bucket], 1))
                held = n
        return turns

    def seen(self, rows: DataFrame, ignore: int | None = None) -> DataFrame:
        """The distinct keys of ``rows`` that some increment holds, ``ignore`` apart."""
        scratch, numbers = Scratch(self.spark, "key-index"), [n for n in self.increments() if n != ignore]
        asks = scratch.stash(self._keyed(rows), "asks")
        if not numbers:
            return asks.select(*self.keys).limit(0)
        pointed = scratch.stash(self._pointed(asks, numbers), "pointed")
        told = pointed.groupBy("bucket").agg(F.countDistinct("h").alias("n"), F.collect_set("number").alias("numbers")).collect()  # a row for each bucket
        likely = scratch.stash(asks.join(pointed.select(F.col("h").alias("__h")).distinct(), "__h", "left_semi"), "likely")
        same, found = F.lit(True), None
        for k in self.keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__old_{k}"))
        folders = {r["bucket"]: [f"{self.path}/keys/{n}/__bucket={r['bucket']}" for n in sorted(r["numbers"])] for r in told}
        for buckets, parts in self._turns({r["bucket"]: r["n"] for r in told}):
            for part in range(parts):  # the bucket took the low digits of the hash, so the parts take the high ones
                block = likely.where(F.col("__bucket").isin(buckets) & (F.pmod(F.shiftrightunsigned("__h", 32), F.lit(parts)) == part))
                more = self._found([f for b in buckets for f in folders[b]], block, same)
                found = more if found is None else found.unionByName(more)
        return scratch.stash(found, "found") if found is not None else asks.select(*self.keys).limit(0)

    def unseen(self, rows: DataFrame, ignore: int | None = None) -> DataFrame:
        """The rows whose key no increment holds; rows that repeat a new key all stay."""
        known = self.seen(rows, ignore)
        held = known.select(*[F.col(k).alias(f"__seen_{k}") for k in self.keys])
        same = F.lit(True)
        for k in self.keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__seen_{k}"))
        return rows.join(held, same, "left_anti")

    def compact(self) -> None:
        """Merge all increments but the newest, which may be written again, once there are ``MANY``.

        What is merged gets a negative number of its own and is whole before the others go.
        """
        numbers = self.increments()
        if len(numbers) < MANY:
            return
        if not self._filters(numbers[:-1]).isEmpty():
            kept = self.spark.read.option("recursiveFileLookup", "true").parquet(*[f"{self.path}/keys/{n}" for n in numbers[:-1]])
            self.add(kept, min(0, numbers[0]) - 1)
        for n in numbers[:-1]:
            remove(self.spark, f"{self.path}/filters/{n}")
            remove(self.spark, f"{self.path}/keys/{n}")
