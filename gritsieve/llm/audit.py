"""Filter interaction audit: what each filter removes in every order of the filters.

Texts are measured in their Arrow buffers: NumPy classes of the bytes mark word starts, capitals, symbols
and code points, prefix sums of the marks are read at the edges of the documents, and every word
gets a rolling hash from prefix sums. Sorted within its document, equal hashes stand side by side; their bytes are
compared, so distinct words are exact. Buffers are scanned in windows that end between words.

Each document becomes one narrow row: a mask of the filters that it fails. Whether a smaller id has the same
text is a minimum by SHA-256 of the text. Rows are counted by part and mask at once, so what the audit of all
orders works on is at most 2^5 times 4 rows for each part; the table of what a mask does at each step of each order
is made from a rule and has a fixed size (32 masks, 600 steps), the only thing broadcast.

Defined results: a null text is an empty one (no words, no code points); a null ``lang`` is the part of
the empty string; a null ``doc_id`` counts as larger than all others, and two null ones as equal; rows that
repeat an id are documents of their own, with the same labels; a label that is null is no label, and any label of
an id counts; labels without a document are ignored; no documents give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gritsieve.llm.arrow import spare, table
from gritsieve.scratch import Scratch

FILTERS = "ABCDE"
MIN_WORDS = 100
DISTINCT_PERCENT = 80
CAPITAL_PERCENT = 10
SYMBOLS = b"#$%&*|"
#: Bytes scanned at once; a longer word is scanned whole.
WINDOW = 1 << 20
#: Multiplier of the rolling hash, odd so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15

_WHITE = np.zeros(256, dtype=bool)
_WHITE[list(b" \t\n\x0b\x0c\r")] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64, by doubling."""
    found, step = np.ones(1, dtype=np.uint64), np.uint64(base)
    while len(found) < n:
        found = np.concatenate([found, found * step])
        step = np.multiply(step, step)
    return found[:n]


class Scan:
    """Counts of the documents of one buffer: words, distinct words, capitals, symbols and code points."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> None:
        self.data, self.offsets, n = data, offsets.astype(np.int64), len(offsets) - 1
        self.words, self.distinct, self.capitals, self.symbols, self.points = (np.zeros(n, dtype=np.int64) for _ in range(5))
        self._left: list[tuple[np.ndarray, ...]] = []  # (doc, hash, start, length) of words whose document reaches beyond its window
        at, end = int(self.offsets[0]), int(self.offsets[-1])
        while at < end:
            stop = self._cut(at, min(at + window, end), end)
            self._window(at, stop)
            at = stop
        if self._left:
            self._count(*(np.concatenate(x) for x in zip(*self._left)))

    def _cut(self, at: int, stop: int, end: int) -> int:
        """The last place up to ``stop`` that is between words, or else the next one after it."""
        if stop == end:
            return end
        edge = int(self.offsets[np.searchsorted(self.offsets, stop, "right") - 1])
        white = np.flatnonzero(_WHITE[self.data[max(at, edge) : stop]])
        best = max(edge, max(at, edge) + int(white[-1]) + 1 if len(white) else at)
        if best > at:
            return best
        edge = int(self.offsets[np.searchsorted(self.offsets, stop)])
        for start in range(stop, edge, 4096):
            white = np.flatnonzero(_WHITE[self.data[start : min(start + 4096, edge)]])
            if len(white):
                return start + int(white[0]) + 1
        return edge

    def _window(self, at: int, stop: int) -> None:
        data = self.data[at:stop]
        first, last = np.searchsorted(self.offsets, at, "right") - 1, np.searchsorted(self.offsets, stop)
        docs = np.arange(first, last)
        low = np.clip(self.offsets[first:last], at, stop) - at
        high = np.clip(self.offsets[first + 1 : last + 1], at, stop) - at
        sums = lambda mark: np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])
        add = lambda total, held: np.add.at(total, docs, held[high] - held[low])
        add(self.capitals, sums((data >= 0x41) & (data <= 0x5A)))
        add(self.symbols, sums(_SYMBOL[data]))
        add(self.points, sums((data & 0xC0) != 0x80))
        word = ~_WHITE[data]
        opens = word.copy()
        opens[1:] &= ~word[:-1]
        opens[low[(low < len(data))]] |= word[low[(low < len(data))]]  # a document's first byte opens a word whatever precedes it
        closes = word.copy()
        closes[:-1] &= ~word[1:]
        inner = high[(high > 0)] - 1
        closes[inner] |= word[inner]
        add(self.words, sums(opens))
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        if not len(start):
            return
        owner = docs[np.searchsorted(low, start, "right") - 1] if len(docs) > 1 else np.full(len(start), first)
        with np.errstate(over="ignore"):
            power = _powers(BASE, len(data) + 1)
            held = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
            back = _powers(pow(BASE, -1, 1 << 64), len(data) + 1)
            hashes = (held[end] - held[start]) * back[start]
        self._split(owner, hashes, start + at, end - start, at, stop)

    def _split(self, owner: np.ndarray, hashes: np.ndarray, start: np.ndarray, length: np.ndarray, at: int, stop: int) -> None:
        """Count the documents that lie in the window; keep the distinct words of those that reach beyond it."""
        beyond = (self.offsets[owner] < at) | (self.offsets[owner + 1] > stop)
        whole = ~beyond
        if whole.any():
            self._count(owner[whole], hashes[whole], start[whole], length[whole])
        if beyond.any():
            part = [x[beyond] for x in (owner, hashes, start, length)]
            order, fresh = self._fresh(*part)
            kept = order[fresh]
            self._left.append(tuple(x[kept] for x in part))

    def _fresh(self, owner: np.ndarray, hashes: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order by document and hash, and which words in it are not their predecessor's equals, byte by byte."""
        order = np.lexsort((hashes, owner))
        o, h, s, n = owner[order], hashes[order], start[order], length[order]
        fresh = np.ones(len(order), dtype=bool)
        same = np.flatnonzero((o[1:] == o[:-1]) & (h[1:] == h[:-1])) + 1
        fresh[same] = False
        verified = n[same] == n[same - 1]
        pairs = same[verified]
        verified[verified] = self._equal(s[pairs], s[pairs - 1], n[pairs])
        clash = np.unique(o[same[~verified]])
        for doc in clash:  # two words of one hash: count this document's words themselves
            rows, seen = np.flatnonzero(o == doc), set()
            for r in rows:
                held = self.data[s[r] : s[r] + n[r]].tobytes()
                fresh[r] = held not in seen
                seen.add(held)
        return order, fresh

    def _equal(self, left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether pairs of words of equal length have the same bytes; some megabytes of them at a time."""
        found, ends = np.ones(len(left), dtype=bool), np.cumsum(length)
        begin = 0
        while begin < len(left):
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + WINDOW, "right")))
            n = length[begin:stop]
            first = np.cumsum(n) - n
            within = np.arange(int(n.sum())) - np.repeat(first, n)
            same = self.data[np.repeat(left[begin:stop], n) + within] == self.data[np.repeat(right[begin:stop], n) + within]
            found[begin:stop] = np.logical_and.reduceat(same, first) if len(same) else True
            begin = stop
        return found

    def _count(self, owner: np.ndarray, hashes: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        order, fresh = self._fresh(owner, hashes, start, length)
        np.add.at(self.distinct, owner[order[fresh]], 1)


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, and where each row starts; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    edges = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1] if offsets is not None and offsets.size else np.zeros(len(column) + 1, kind)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), edges


def filter_flags(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, failed, digest): the filters A to D that each document fails, as bits, and its text's SHA-256."""
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("lang"), docs["text"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, edges = _buffer(batch.column("text"))
            scan = Scan(data, edges)
            fails = (scan.words < MIN_WORDS, 100 * scan.distinct < DISTINCT_PERCENT * scan.words, 100 * scan.capitals > CAPITAL_PERCENT * scan.points, scan.symbols > 0)
            digests = [hashlib.sha256(data[a:b]).digest() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            yield table({
                "doc_id": (batch.column("doc_id"), pa.int64()), "lang": (batch.column("lang"), pa.string()),
                "failed": (sum(f.astype(np.int32) << k for k, f in enumerate(fails)), pa.int32()), "digest": (digests, pa.binary()),
            })

    return slim.mapInArrow(run, "doc_id long, lang string, failed int, digest binary")


def _steps(filters: str = FILTERS) -> list[tuple]:
    """(mask, order, step, kept, removed, redundant) for every mask, order and step."""
    found = []
    for order in map("".join, permutations(filters)):
        bits, before = [1 << filters.index(f) for f in order], 0
        for step, bit in enumerate(bits, 1):
            for mask in range(1 << len(filters)):
                gone, fails = bool(mask & before), bool(mask & bit)
                found.append((mask, order, step, int(not gone and not fails), int(fails and not gone), int(fails and gone), int(mask == bit)))
            before |= bit
    return found


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for every part, order of the filters and step."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "audit")
    flags = scratch.stash(filter_flags(docs), "flags")
    # of texts that occur once nothing is joined; a null id comes last
    several = flags.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1").select("digest", "first")
    copy = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    masks = flags.join(scratch.stash(several, "several"), "digest", "left").select("doc_id", "lang", (F.col("failed") + F.when(copy, 16).otherwise(0)).alias("mask"))
    (of,) = spare(["doc_id"], "id")
    marks = labels.select(labels["doc_id"].cast("long").alias(of), (labels["quality"] == 1).alias("good"), (labels["toxic"] == 1).alias("toxic"))
    marks = marks.where(F.col(of).isNotNull()).groupBy(of).agg(*[F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("good", "toxic")]).where("good or toxic")
    labelled = masks.join(marks, F.col("doc_id") == F.col(of), "left")
    counts = labelled.groupBy(F.col("lang").alias("part"), "mask").agg(F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in ("good", "toxic")])
    counts = scratch.stash(counts, "counts")
    steps = spark.createDataFrame(_steps(), "mask int, filter_order string, step int, kept_ int, removed_ int, redundant_ int, unique_ int")
    total = lambda flag, of="n": F.sum(F.col(flag) * F.col(of)).cast("long")
    # every part has every mask's steps: a part without a mask adds nothing there, and each part has one mask at least
    told = counts.join(F.broadcast(steps), "mask").groupBy("part", "filter_order", "step").agg(
        total("kept_").alias("kept"), total("removed_").alias("removed"), total("redundant_").alias("redundant"), total("unique_").alias("unique_fails"),
        total("removed_", "good").alias("good_lost"), total("removed_", "toxic").alias("toxic_lost"),
    )
    told = scratch.stash(told.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1))), "told")
    share = told.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return told.join(share, ["part", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
