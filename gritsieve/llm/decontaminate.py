"""Benchmark decontamination with an Aho-Corasick automaton.

The word windows of the benchmark's questions and answers become the patterns of one automaton;
every document is normalised once, scanned once, and the matches are mapped back to word numbers and
to code points of the original text. Documents are never shuffled.

What is collected and broadcast is bounded: the benchmark's size is counted on the cluster first. If
its windows make up to ``automaton_bytes``, they are one automaton. A larger benchmark is cut to pieces of
``PIECE_WORDS`` words that overlap by a window less one word; distinct pieces are dealt by a hash of name and
text into shards of that size, so a long item, a null or a repeated ``item_id`` is spread like any other. One shard at a
time goes to the executors, each task builds its automaton once, and what it hits is written to the shared
folder; then each document's hits of all shards are joined. Texts are read once for each shard.

Defined results: a null or wordless text has no words, no hits and is not contaminated; items that
are null or wordless have no windows; rows that repeat an ``item_id`` add their windows to it; a null
``item_id`` is reported as an empty id; repeated documents are judged each on its own; empty tables
give no hits or no rows; other columns are ignored, or returned unchanged by the filter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gritsieve.llm.arrow import raw, spare, table
from gritsieve.scratch import Scratch

WINDOW = 13
MIN_SHARE = 20
AUTOMATON_BYTES = 32 << 20
#: Words of a piece of an item, where a benchmark is dealt to several shards.
PIECE_WORDS = 4096
#: Bytes of words: digits, letters (upper case is folded) and everything beyond ASCII.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def normalise(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


@dataclass(frozen=True)
class Shard:
    """Patterns of some items: padded window text, its words, the numbers of the items that hold it, and their names."""

    patterns: tuple[str, ...]
    lengths: tuple[int, ...]
    owners: tuple[tuple[int, ...], ...]
    names: tuple[str, ...]


def shard_of(items: Iterable[tuple[str | None, bytes | None]], window: int) -> Shard:
    """The distinct windows of (name, text) pairs."""
    owners: dict[bytes, dict[int, None]] = {}
    names: dict[str, int] = {}
    for name, text in items:
        number, words = names.setdefault(name or "", len(names)), normalise(text)
        for at in range(max(1, len(words) - window + 1) if words else 0):
            owners.setdefault(b" ".join(words[at : at + window]), {})[number] = None
    found = sorted(owners)
    return Shard(tuple(f" {p.decode('latin-1')} " for p in found), tuple(p.count(b" ") + 1 for p in found), tuple(tuple(owners[p]) for p in found), tuple(names))


class Scanner:
    """An automaton over one shard; bytes are scanned as Latin-1 characters, one each."""

    def __init__(self, shard: Shard) -> None:
        self.shard = shard
        self.automaton = ahocorasick.Automaton()
        for k, pattern in enumerate(shard.patterns):
            self.automaton.add_word(pattern, k)
        if shard.patterns:
            self.automaton.make_automaton()

    def find(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(first word, words, pattern) of every occurrence, overlapping ones too."""
        if not words or not self.shard.patterns:
            return []
        found = list(self.automaton.iter(f" {b' '.join(words).decode('latin-1')} "))
        if not found:
            return []
        ends = np.cumsum([len(w) + 1 for w in words])  # the place of the space after each word
        last = np.searchsorted(ends, [end for end, _ in found])
        return [(int(word) - self.shard.lengths[k] + 1, self.shard.lengths[k], k) for word, (_, k) in zip(last, found)]


def _hits(n_words: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    hit = np.zeros(n_words + 1, dtype=np.int32)
    for first, length, _ in found:
        hit[first] += 1
        hit[first + length] -= 1
    return np.cumsum(hit[:n_words]) > 0


def word_spans(text: bytes) -> np.ndarray:
    """Code points of the original text at which each word starts and ends (exclusive)."""
    data = np.frombuffer(text, dtype=np.uint8)
    word = np.concatenate([[False], np.frombuffer(text.translate(FOLD), dtype=np.uint8) != 0x20, [False]])
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return points[edge].reshape(-1, 2)


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return [(int(a), int(b)) for a, b in edge.reshape(-1, 2)]


def _found(scanner: Scanner, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
    """Which words are hit, and the names of the items."""
    found = scanner.find(words)
    return _hits(len(words), found), {scanner.shard.names[o] for *_, p in found for o in scanner.shard.owners[p]}


class Verdict(NamedTuple):
    n_words: int
    n_hit: int
    items: list[str]
    spans: list[tuple[int, int]]
    contaminated: bool


def verdict(text: bytes | None, n_words: int, hit: np.ndarray, items: Iterable[str], min_share: int) -> Verdict:
    n_hit = int(hit.sum())
    spans = [(int(at[a, 0]), int(at[b - 1, 1])) for at in [word_spans(text)] for a, b in _runs(hit)] if n_hit else []
    return Verdict(n_words, n_hit, sorted(items), spans, n_hit > 0 and min_share * n_hit >= n_words)


def _shard_count(benchmark: DataFrame, window: int, automaton_bytes: int) -> int:
    """How many shards the benchmark's windows make: every byte is in ``window`` of them at most."""
    held = benchmark.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    return max(1, -(-held * window // automaton_bytes))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("name"), F.col("text").cast("binary").alias("text"))


def _pieces(items: DataFrame, window: int) -> DataFrame:
    """(name, text): distinct normalised pieces that hold every window of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(PIECE_WORDS, 2 * window)
        for batch in batches:
            found: list[tuple[str | None, bytes]] = []
            for name, text in zip(batch.column("name").to_pylist(), raw(batch, "text")):
                words = normalise(text)
                found += [(name, b" ".join(words[at : at + size])) for at in range(0, max(1, len(words) - window + 1), size - window + 1)] if words else []
            yield table({"name": ([n for n, _ in found], pa.string()), "text": ([t for _, t in found], pa.binary())})

    return items.mapInArrow(run, "name string, text binary").distinct()


def _collected(items: DataFrame, window: int) -> Shard:
    """A shard on the driver; the caller has counted that it is small."""
    return shard_of(((r["name"], bytes(r["text"]) if r["text"] is not None else None) for r in items.toLocalIterator()), window)


def _hit_table(docs: DataFrame, benchmark: DataFrame, window: int, count: int, scratch: Scratch) -> DataFrame:
    """(doc_id, row, runs, items) of all documents that some shard hits, one shard after the other."""
    items = scratch.stash(_pieces(_items(benchmark), window).withColumn("shard", F.pmod(F.xxhash64("name", "text"), F.lit(count))), "items", "shard")
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("row"), docs["text"].alias("text"))
    tables = []
    for number in range(count):
        shared = docs.sparkSession.sparkContext.broadcast(_collected(items.where(F.col("shard") == number), window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            scanner = Scanner(shared.value)
            for batch in batches:
                found = [(k, *_found(scanner, normalise(t))) for k, t in enumerate(raw(batch, "text"))]
                found = [f for f in found if f[1].any()]
                at = pa.array([f[0] for f in found], pa.int64())
                runs = [[{"first": a, "last": b} for a, b in _runs(f[1])] for f in found]
                yield table({
                    "doc_id": (batch.column("doc_id").take(at), pa.int64()), "row": (batch.column("row").take(at), pa.int64()),
                    "runs": (runs, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), "items": ([sorted(f[2]) for f in found], pa.list_(pa.string())),
                })

        tables.append(scratch.stash(slim.mapInArrow(run, "doc_id long, row long, runs array<struct<first:long,last:long>>, items array<string>"), f"hits-{number}"))
        shared.destroy()
    hits = tables[0]
    for more in tables[1:]:
        hits = hits.unionByName(more)
    return hits.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def _judged(docs: DataFrame, benchmark: DataFrame, window: int, automaton_bytes: int, min_share: int, out: Callable, schema) -> DataFrame:
    """``out(batch, verdicts)`` for every batch of ``docs``."""
    count = _shard_count(benchmark, window, automaton_bytes)
    if count == 1:
        shared = docs.sparkSession.sparkContext.broadcast(_collected(_items(benchmark), window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = Scanner(shared.value)
            for batch in batches:
                texts = raw(batch, "text")
                words = list(map(normalise, texts))
                yield out(batch, [verdict(t, len(w), *_found(scanner, w), min_share) for t, w in zip(texts, words)])

        return docs.mapInArrow(run, schema)
    hits = _hit_table(docs, benchmark, window, count, Scratch(docs.sparkSession, "decontaminate"))
    of, row, text_row, runs, items = spare(docs.columns, "id", "row", "text_row", "runs", "items")
    hits = hits.select(F.col("doc_id").alias(of), F.col("row").alias(row), F.col("runs").alias(runs), F.col("items").alias(items))
    keyed = docs.withColumn(text_row, F.xxhash64(docs["text"]))
    joined = keyed.join(hits, docs["doc_id"].cast("long").eqNullSafe(F.col(of)) & (F.col(text_row) == F.col(row)), "left").select(*[F.col(f"`{c}`") for c in docs.columns], runs, items)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.select(batch.schema.names[:-2])
            found = []
            for text, runs, items in zip(raw(own, "text"), batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                n = len(normalise(text))
                hit = np.zeros(n, dtype=bool)
                for r in runs or ():
                    hit[r["first"] : r["last"]] = True
                found.append(verdict(text, n, hit, items or (), min_share))
            yield out(own, found)

    return joined.mapInArrow(join, schema)


REPORT_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start:long,end:long>>"


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: int = MIN_SHARE, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """One row for every document: hit words, items found, spans in the original text and the verdict."""

    def out(batch: pa.RecordBatch, found: list[Verdict]) -> pa.RecordBatch:
        return table({
            "doc_id": (batch.column("doc_id"), pa.int64()), "n_words": ([f.n_words for f in found], pa.int64()), "n_hit": ([f.n_hit for f in found], pa.int64()),
            "n_items": ([len(f.items) for f in found], pa.int64()), "items_sha256": ([hashlib.sha256(",".join(f.items).encode()).hexdigest() for f in found], pa.string()),
            "contaminated": ([f.contaminated for f in found], pa.bool_()), "items": ([f.items for f in found], pa.list_(pa.string())),
            "spans": ([[{"start": a, "end": b} for a, b in f.spans] for f in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        })

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return _judged(slim, benchmark, window, automaton_bytes, min_share, out, REPORT_SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: int = MIN_SHARE, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""

    def out(batch: pa.RecordBatch, found: list[Verdict]) -> pa.RecordBatch:
        return batch.filter(pa.array([not f.contaminated for f in found], pa.bool_()))

    return _judged(docs, benchmark, window, automaton_bytes, min_share, out, docs.schema)
