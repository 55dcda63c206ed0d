"""Line dedup over levelled sorted runs of line hashes.

The index is a set of runs, each a table of (128-bit line hash, number of documents) bucketed by hash
and sorted within its buckets. Documents come in batches. A batch counts its own hashes, drops those
that the runs already know to be frequent by a merge anti-join, and adds the rest as a run of the
lowest level; ``fanout`` runs of one level are merged into one of the next. Only a batch's own hashes
are shuffled: runs are read bucket by bucket. In the end the lines whose hash reached ``min_docs``
documents leave every document. With ``index``, a folder, the runs stay for the next call, which then
counts the documents of all calls; texts of earlier calls are not touched again.

One pass over the texts hashes them, one rewrites them; in between only hashes move. Counts are
combined on the map side, so a line of every document is one row from each task; the join that finds
a frequent line's documents is a plain equi-join that can be split at run time; a document's hits are
bounded by its own lines.

Defined results: a null or empty text is one empty line, which is never dropped; every row counts as
a document of its own, repeated rows and rows without ``doc_id`` included; an empty table gives an
empty result; other columns are ignored by the report and returned unchanged by ``dedup_lines``, save
``n_chars``, which follows the text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from gritsieve.llm.arrow import raw, spare, table
from gritsieve.scratch import Scratch, remove

MIN_DOCS = 10
MIN_CHARS = 1
BATCHES = 4
FANOUT = 2
WHITE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()


def _points(key: bytes) -> int:
    return len(key.decode("utf-8", "replace"))


def text_keys(text: bytes | None, min_chars: int) -> np.ndarray:
    """The distinct 128-bit hashes of a text's keys, as rows of two longs."""
    keys = {line_key(line) for line in (text or b"").split(b"\n")}
    keys.discard(b"")
    if min_chars > 1:
        keys = {k for k in keys if _points(k) >= min_chars}
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype="<i8").reshape(-1, 2)


KEYS_SCHEMA = "batch int, doc_id long, row long, h1 long, h2 long"


def line_keys(docs: DataFrame, min_chars: int, batches: int) -> DataFrame:
    """One row for each document and distinct key; a batch is made of whole input partitions."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_no = (TaskContext.get().partitionId() if TaskContext.get() else 0) % batches
        for part in parts:
            found = [text_keys(t, min_chars) for t in raw(part, "text")]
            counts = np.array([len(f) for f in found], dtype=np.int64)
            all_keys = np.concatenate(found) if found else np.empty((0, 2), dtype="<i8")
            at = pa.array(np.repeat(np.arange(len(found)), counts))
            yield table({
                "batch": (np.full(len(all_keys), batch_no, dtype=np.int32), pa.int32()),
                "doc_id": (part.column("doc_id").take(at), pa.int64()),
                "row": (part.column("row").take(at), pa.int64()),
                "h1": (np.ascontiguousarray(all_keys[:, 0]), pa.int64()),
                "h2": (np.ascontiguousarray(all_keys[:, 1]), pa.int64()),
            })

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("row"), docs["text"].alias("text"))
    return slim.mapInArrow(run, KEYS_SCHEMA)


STATE_SCHEMA = "level int, run string, buckets int, min_docs int, min_chars int"


class LineIndex:
    """Levels of sorted runs of (h1, h2, n) in one folder of the shared file system.

    A run is a table bucketed by hash. ``save`` records which runs make up the index, as a small table
    that counts once Spark has committed it; a folder that holds such a state is opened where it was
    left. One writer at a time. ``min_docs`` and ``min_chars`` belong to the folder: others are refused,
    as keys that were frequent are no longer counted. The session's shuffle partitions give the buckets.
    """

    def __init__(self, spark: SparkSession, folder: str, min_docs: int = MIN_DOCS, fanout: int = FANOUT, min_chars: int = MIN_CHARS) -> None:
        if fanout < 2:
            raise ValueError("a level must hold two runs at least before they are merged")
        self.spark, self.folder, self.min_docs, self.fanout, self.min_chars = spark, folder.rstrip("/"), min_docs, fanout, min_chars
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self._stale: list[str] = []
        self.state = max(self._states(), default=0)
        if self.state:
            self._load()

    def _states(self) -> list[int]:
        """The numbers of the committed states."""
        pattern = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state-*/_SUCCESS")
        found = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
        return [int(f.getPath().getParent().getName().removeprefix("state-")) for f in found or []]

    def _load(self) -> None:
        for held in self.spark.read.schema(STATE_SCHEMA).parquet(f"{self.folder}/state-{self.state}").orderBy("level", "run").collect():
            if (held["min_docs"], held["min_chars"]) != (self.min_docs, self.min_chars):
                raise ValueError(f"{self.folder}: made for min_docs {held['min_docs']} and min_chars {held['min_chars']}")
            self.levels += [[] for _ in range(held["level"] + 1 - len(self.levels))]
            self.levels[held["level"]].append(held["run"])
            self.buckets = held["buckets"]
            if not self.spark.catalog.tableExists(held["run"]):
                place = f"{self.folder}/{held['run']}".replace("'", "\\'")
                self.spark.sql(
                    f"CREATE TABLE {held['run']} (h1 BIGINT, h2 BIGINT, n BIGINT) USING parquet LOCATION '{place}' "
                    f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {held['buckets']} BUCKETS"
                )

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def _write(self, counts: DataFrame) -> str:
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:
            counts = counts.repartition(self.buckets, "h1", "h2")  # else every task already holds whole buckets
        run = f"line_run_{uuid.uuid4().hex}"
        counts.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.folder}/{run}").saveAsTable(run)
        return run

    def _merged(self, first: str, second: str) -> DataFrame:
        other = self.spark.table(second).withColumnRenamed("n", "m").hint("merge")
        both = self.spark.table(first).hint("merge").join(other, ["h1", "h2"], "full_outer")
        return both.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))

    def _compact(self, runs: list[str]) -> str:
        merged = runs[0]
        for run in runs[1:]:
            merged = self._write(self._merged(merged, run))
            self._stale.append(merged)
        self._stale.remove(merged)
        self._stale += runs
        return merged

    def add(self, keys: DataFrame) -> None:
        """Count a batch of (h1, h2) rows into the index."""
        counts = keys.groupBy("h1", "h2").agg(F.count("*").alias("n"))
        for run in self.runs():  # keys known to be frequent need no further count
            known = self.spark.table(run).where(F.col("n") >= self.min_docs).select("h1", "h2")
            counts = counts.join(known.hint("merge"), ["h1", "h2"], "left_anti")
        self.levels[0].append(self._write(counts))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._compact(self.levels[level]))
            self.levels[level] = []
            level += 1

    def frequent(self) -> DataFrame:
        """The (h1, h2) of all keys found in at least ``min_docs`` documents."""
        runs = self.runs()
        if len(runs) > 2:  # a merge of its own, the levels stay
            whole = self._write(self._merged(runs[0], runs[1]))
            for run in runs[2:]:
                self._stale.append(whole)
                whole = self._write(self._merged(whole, run))
            self._stale.append(whole)
            runs = [whole]
        counts = self.spark.table(runs[0]) if len(runs) == 1 else self._merged(*runs)
        return counts.where(F.col("n") >= self.min_docs).select("h1", "h2")

    def _forget(self, runs: list[str]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")  # the files stay: its place was given

    def save(self) -> None:
        """Commit the present runs, then delete those that were merged away."""
        rows = [(level, run, self.buckets, self.min_docs, self.min_chars) for level, held in enumerate(self.levels) for run in held]
        self.spark.createDataFrame(rows, STATE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/state-{self.state + 1}")
        self.state += 1
        self._forget(self._stale)
        for name in [*self._stale, *[f"state-{n}" for n in self._states() if n < self.state]]:
            remove(self.spark, f"{self.folder}/{name}")
        self._stale = []

    def close(self) -> None:
        """Leave no table in the session's catalog; what was saved can be opened again."""
        self._forget(self.runs() + self._stale)


def _with_hits(docs: DataFrame, min_docs: int, min_chars: int, batches: int, fanout: int, folder: str | None) -> DataFrame:
    """The documents and one more column: the first halves of the hashes of their frequent lines, or null."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    index = LineIndex(docs.sparkSession, folder or scratch.path("index"), min_docs, fanout, min_chars)
    keys = scratch.stash(line_keys(docs, min_chars, batches), "keys", "batch")
    try:
        for number in range(batches):
            index.add(keys.where(F.col("batch") == number))
        frequent = scratch.stash(index.frequent(), "frequent")
        if folder:
            index.save()
    finally:
        index.close()
    if not folder:
        scratch.drop("index")
    of, row, text_row, hits = spare(docs.columns, "id", "row", "text_row", "hits")
    found = keys.join(frequent, ["h1", "h2"], "left_semi").groupBy(F.col("doc_id").alias(of), F.col("row").alias(row)).agg(F.collect_set("h1").alias(hits))
    keyed = docs.withColumn(text_row, F.xxhash64(docs["text"]))
    joined = keyed.join(found, docs["doc_id"].cast("long").eqNullSafe(F.col(of)) & (F.col(text_row) == F.col(row)), "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(hits))


def cleaned(text: bytes | None, hits: list[int] | None, min_chars: int) -> tuple[bytes, int, int]:
    """The text without the lines whose hash is among the hits; the number of lines before and dropped."""
    data = text or b""
    if not hits:
        return data, data.count(b"\n") + 1, 0
    lines, drop, kept = data.split(b"\n"), set(hits), []
    for line in lines:
        key = line_key(line)
        frequent = key and (min_chars <= 1 or _points(key) >= min_chars) and int.from_bytes(xxhash.xxh3_128_digest(key)[:8], "little", signed=True) in drop
        if not frequent:
            kept.append(line)
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


REPORT_SCHEMA = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"


def line_dedup_report(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT, index: str | None = None) -> DataFrame:
    """For each document: its lines, those dropped, and the hash of what stays."""
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    joined = _with_hits(slim, min_docs, min_chars, batches, fanout, index)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [cleaned(t, h, min_chars) for t, h in zip(raw(part, "text"), part.column(2).to_pylist())]
            yield table({
                "doc_id": (part.column("doc_id"), pa.int64()),
                "n_lines": ([f[1] for f in found], pa.int64()),
                "n_dropped": ([f[2] for f in found], pa.int64()),
                "kept_sha256": ([hashlib.sha256(f[0]).hexdigest() for f in found], pa.string()),
            })

    return joined.mapInArrow(run, REPORT_SCHEMA)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT, index: str | None = None) -> DataFrame:
    """The documents without their frequent lines, with all their columns."""
    joined = _with_hits(docs, min_docs, min_chars, batches, fanout, index)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            hits = part.column(part.num_columns - 1).to_pylist()
            texts = [t if t is None or not h else cleaned(t, h, min_chars)[0] for t, h in zip(raw(part, "text"), hits)]
            columns = {}
            for name in part.schema.names[:-1]:
                kind = part.schema.field(name).type
                if name == "text":
                    columns[name] = pa.array(texts, pa.binary() if pa.types.is_string(kind) else pa.large_binary()).cast(kind)
                elif name == "n_chars":
                    old = part.column(name).to_pylist()
                    columns[name] = pa.array([n if not h else _points(t) for n, h, t in zip(old, hits, texts)], kind)
                else:
                    columns[name] = part.column(name)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return joined.mapInArrow(run, docs.schema)
