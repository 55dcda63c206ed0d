"""Exact dedup of long byte strings by a distributed difference-cover suffix sort.

Every byte that lies in a string of ``length`` bytes which also starts earlier in the corpus is
removed. For a length of 100:

1. **Sample.** Places are sampled by a difference cover: two in three, of these two in three again,
   and once more, that is 8 places in 27. Letters of three and nine bytes are their own names, so
   only the third level has to be sorted.
2. **Sort the sampled triples.** Each block of the corpus sends the distinct keys of its samples
   (triples of letters, 20 bytes in all) to ranges of keys; each range is sorted and its keys get
   names in order. Samples whose name occurs once cannot lie in a repeat and are discarded.
3. **Recurse on the names.** The triple of names at a place and one and two strides on is sorted and
   named in the same way, until the names stand for all bytes that are needed (74).
4. **Merge the remaining suffixes.** A string that starts k places before a sample is k letters, the
   sample's name, and what is left of the string behind it. Samples of one name meet with the bytes
   around them; their strings of every shift are brought into order and adjacent ones are compared.
   Two equal strings always have a shift at which both are before a sample, so none is missed.
5. Strings that start earlier elsewhere mark their bytes, and each document is cut once.

The work is dealt in rounds of key ranges, so that the files of one round only are on disk. Keys are
made distinct by block before they move, and what comes back is addressed to the block, so a key that
a third of the corpus holds is one row of each block. A name of more than ``hot`` samples is merged
string by string in the same manner. A range is bounded by splitters from a bounded sample of
keys, which steer the balance and nothing else.

Defined results: a null text is empty; a null ``doc_id`` comes after all others; rows that share a
``doc_id`` are ordered by a hash of their text, and rows that repeat id and text are one document
with one result each; a text shorter than ``length`` loses nothing; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from gritsieve.llm import suffix as sx
from gritsieve.llm.arrow import raw, table
from gritsieve.scratch import Scratch

LENGTH = 100
#: Samples of one name that are merged in one task; a name with more is merged string by string.
HOT = 1 << 15
BLOCK_BYTES = 5 << 20
#: Bytes of keys that one round moves, for each byte of text, and that one range gets.
ROUND_SHARE = 2.0
RANGE_BYTES = 1 << 24
#: Keys that are sampled for splitters, for each range and at most.
RANGE_KEYS = 100
MOST_KEYS = 500_000
LAST_ID = (1 << 63) - 1
HOT_BIT = 1 << 62
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Let Spark drop the shuffle files of each query as soon as its result is written."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, row, text): ``doc`` orders documents; ``row`` is 0 unless some id occurs twice."""
    ids = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST_ID)).alias("doc"))
    twice = ids.groupBy("doc").count().where("count > 1").limit(1).count() > 0
    row = F.xxhash64(docs["text"]) if twice else F.lit(0).cast("long")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST_ID)).alias("doc"), row.alias("row"), docs["text"].alias("text"))


# --- blocks ------------------------------------------------------------------------------------

BLOCK_SCHEMA = "block long, doc array<long>, row array<long>, base array<long>, size array<long>, n_bytes long, data binary"
_LONGS = pa.list_(pa.int64())


def text_blocks(keyed: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """The texts in the order of the corpus, packed into numbered blocks.

    A text longer than a block is cut into pieces that share ``length - 1`` bytes, so every string is
    in one piece. Numbers follow the order of the corpus. Data is compressed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, pieces = TaskContext.get().partitionId() << 20, 0, []

        def done() -> pa.RecordBatch:
            doc, row, base, data = zip(*pieces)
            sizes = [len(x) for x in data]
            return table({
                "block": ([number], pa.int64()), "doc": ([doc], _LONGS), "row": ([row], _LONGS), "base": ([base], _LONGS), "size": ([sizes], _LONGS),
                "n_bytes": ([sum(sizes)], pa.int64()), "data": ([sx.squeeze(b"".join(data))], pa.binary()),
            })

        for batch in batches:
            for doc, row, text in zip(batch.column("doc").to_pylist(), batch.column("row").to_pylist(), raw(batch, "text")):
                for base in range(0, len(text) - length + 1, block_bytes):
                    piece = text[base : base + block_bytes + length - 1]
                    pieces.append((doc, row, base, piece))
                    held += len(piece)
                    if held >= block_bytes:
                        yield done()
                        number, held, pieces = number + 1, 0, []
        if pieces:
            yield done()

    spark = keyed.sparkSession
    texts = keyed.where(F.octet_length("text") >= length).select("doc", "row", "text")
    if keyed.select("row").where("row <> 0").limit(1).count():  # ids repeat, and rows may
        texts = texts.dropDuplicates(["doc", "row"])
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return texts.repartitionByRange(parts, "doc", "row").sortWithinPartitions("doc", "row").mapInArrow(run, BLOCK_SCHEMA)


def _blocks_of(batch: pa.RecordBatch, plan: sx.Plan) -> Iterator[tuple[int, sx.Block]]:
    number, base, size = (batch.column(c).to_pylist() for c in ("block", "base", "size"))
    for k, data in enumerate(batch.column("data")):
        yield k, sx.Block(number[k], sx.unsqueeze(data.as_buffer()), base[k], size[k], plan)


# --- keys --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Level:
    """One naming: which places are named, by keys of ``key_bytes``; ``width`` is what the names so far stand for."""

    kind: str  # "letters", "triples" or "strings"
    width: int
    key_bytes: int


#: Places, the first eight bytes of their keys as numbers, and a function that gives the keys of some of them.
Keys = tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], np.ndarray]]


def _named(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    return sx.unpack_places(batch.column("places")[k].as_py()), sx.unpack(batch.column("names")[k].as_py(), "<i8")


def _keys(level: Level, block: sx.Block, batch: pa.RecordBatch, k: int) -> Iterator[Keys]:
    """The keys of a block, in one part or, for strings, one for each shift."""
    if level.kind == "letters":
        places = block.sampled(level.width)
        yield places, block.prefixes(places), lambda at: block.bytes_at(at, level.width)
        return
    places, names = _named(batch, k)
    of = np.zeros(block.n + 1, dtype=np.int64)
    of[places] = names
    if level.kind == "triples":
        there = sx.triple_places(block, of, places, level.width)
        yield there, of[there].astype(np.uint64), lambda at: sx.triples(block, of, at, level.width)
        return
    around, places = block.plan.around, places[names >= HOT_BIT]
    before, ahead = block.room(places)
    for shift in range(around + 1):
        at = places[(before >= shift) & (ahead - block.plan.depth >= around - shift)]

        def strings(starts: np.ndarray, shift: int = shift) -> np.ndarray:
            s = starts + shift
            lead = np.full((len(s), 1), shift, dtype=np.uint8) if around < 256 else np.full((len(s), 1), shift, dtype=">u2").view(np.uint8)
            return np.concatenate([lead, sx.big_endian(of[s]), block.bytes_at(starts, shift), block.bytes_at(s + block.plan.depth, around - shift)], axis=1)

        heads = strings(at - shift)[:, :8] if len(at) else np.empty((0, 8), dtype=np.uint8)
        yield at - shift, sx.words_of(heads)[:, 0] if len(at) else np.empty(0, dtype=np.uint64), strings


def _splitters(state: DataFrame, plan: sx.Plan, level: Level, n_keys: int, ranges: int) -> np.ndarray:
    """``ranges - 1`` keys that cut all keys into ranges of about one size, from a bounded sample."""
    share = min(1.0, min(RANGE_KEYS * ranges, MOST_KEYS) / max(1, n_keys))
    most = np.uint64(min((1 << 64) - 1, int(share * (1 << 64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, block in _blocks_of(batch, plan):
                for places, _, keys in _keys(level, block, batch, k):
                    drawn = sx.mixed((places.astype(np.uint64) + np.uint64(block.number << 24)) * np.uint64(0x9E3779B97F4A7C15)) <= most
                    yield table({"key": ([x.tobytes() for x in keys(places[drawn])] if drawn.any() else [], pa.binary())})

    drawn = np.sort(np.array(state.mapInArrow(run, "key binary").toArrow().column("key").to_pylist(), dtype=f"S{level.key_bytes}"))
    if not len(drawn):
        return np.full(ranges - 1, b"\xff" * level.key_bytes, dtype=f"S{level.key_bytes}")
    return drawn[(np.arange(1, ranges) * len(drawn)) // ranges]


SENT_SCHEMA = "part int, block long, kind int, n int, keys binary, counts binary, places binary"


def _sent(state: DataFrame, plan: sx.Plan, level: Level, splits: np.ndarray, first: int, parts: int) -> DataFrame:
    """Each block's distinct keys of the ranges ``first`` to ``first + parts``; kind 1 has the repeats within the block."""
    low = splits[first - 1 : first]
    high = splits[first + parts - 1 : first + parts]
    within = splits[first : first + parts - 1]
    edge = lambda x: np.uint64(int.from_bytes(x[:8].ljust(8, b"\0"), "big"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, block in _blocks_of(batch, plan):
                for places, prefix, keys in _keys(level, block, batch, k):
                    fits = np.ones(len(places), dtype=bool)
                    if len(low):
                        fits &= prefix >= edge(low[0])
                    if len(high):
                        fits &= prefix <= edge(high[0])
                    places = places[fits]
                    if not len(places):
                        continue
                    found, count, head, again = sx.distinct(keys(places), places)
                    a = int(sx.cut_points(found, low)[0]) if len(low) else 0
                    b = int(sx.cut_points(found, high)[0]) if len(high) else len(found)
                    bounds = np.concatenate([[a], sx.cut_points(found, within), [b]])
                    rows = [(first + j, 0, int(y - x), sx.squeeze(found[x:y].tobytes()), sx.pack(np.minimum(count[x:y], 65535).astype("<u2")), sx.pack(head[x:y].astype("<i4")))
                            for j, (x, y) in enumerate(zip(bounds[:-1], bounds[1:])) if y > x]
                    of_range = np.zeros(block.n, dtype=bool)
                    of_range[head[a:b]] = True
                    if (inside := of_range[again[0]]).any():
                        rows.append((first + block.number % parts, 1, int(inside.sum()), None, None, sx.pack(again[:, inside].T.astype("<i4"))))
                    part, kind, n, key, counts, at = zip(*rows) if rows else [()] * 6
                    yield table({
                        "part": (part, pa.int32()), "block": ([block.number] * len(part), pa.int64()), "kind": (kind, pa.int32()), "n": (n, pa.int32()),
                        "keys": (key, pa.binary()), "counts": (counts, pa.binary()), "places": (at, pa.binary()),
                    })

    return state.mapInArrow(run, SENT_SCHEMA)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each range, together."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for part, found in groupby(rows, key=lambda r: r["part"]):
        yield part, list(found)


def _ranges(sent: DataFrame, first: int, parts: int) -> DataFrame:
    return sent.repartitionById(parts, F.col("part") - first).sortWithinPartitions("part", "block")


@dataclass(frozen=True)
class Meeting:
    """The keys of one range from all blocks: the group of each key, groups in the order of keys, rows in that of the corpus."""

    rows: list[dict]
    begin: np.ndarray
    group: np.ndarray
    order: np.ndarray
    counts: np.ndarray
    places: np.ndarray


def _meeting(rows: list[dict], key_bytes: int) -> Meeting:
    keys = np.concatenate([np.frombuffer(sx.unsqueeze(r["keys"]), dtype=np.uint8).reshape(-1, key_bytes) for r in rows])
    order, new = sx.key_order(sx.words_of(keys))
    group = np.empty(len(keys), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    begin = np.cumsum([0] + [r["n"] for r in rows])
    counts, places = np.concatenate([sx.unpack(r["counts"], "<u2") for r in rows]), np.concatenate([sx.unpack(r["places"], "<i4") for r in rows])
    return Meeting(rows, begin, group, order, counts, places)


NAMED_SCHEMA = "block long, kind int, places binary, names binary"


def _names(sent: DataFrame, key_bytes: int, hot: int) -> DataFrame:
    """Names in the order of keys, back to the blocks: for keys that occur twice or more in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_part(batches):
            out = [(r["block"], 1, r["places"], None) for r in rows if r["kind"] == 1]
            rows = [r for r in rows if r["kind"] == 0]
            if rows:
                met = _meeting(rows, key_bytes)
                total = np.bincount(met.group, weights=met.counts)
                name = (part << 32) + np.arange(1, len(total) + 1) + np.where(total > hot, HOT_BIT, 0)
                for r, a, b in zip(rows, met.begin[:-1], met.begin[1:]):
                    at = a + np.flatnonzero(total[met.group[a:b]] > 1)
                    if len(at):
                        at = at[np.argsort(met.places[at])]
                        out.append((r["block"], 0, sx.pack_places(met.places[at]), sx.pack(name[met.group[at]].astype("<i8"))))
            block, kind, places, names = zip(*out) if out else [()] * 4
            yield table({"block": (block, pa.int64()), "kind": (kind, pa.int32()), "places": (places, pa.binary()), "names": (names, pa.binary())})

    return sent.mapInArrow(run, NAMED_SCHEMA)


STATE_SCHEMA = "block long, base array<long>, size array<long>, data binary, places binary, names binary, n long, n_hot long"


def _carried(state: DataFrame, named: DataFrame, plan: sx.Plan) -> DataFrame:
    """The blocks with the names of their places; blocks without any, and bytes out of reach of any, are discarded."""
    found = named.groupBy("block").agg(F.collect_list(F.struct("kind", "places", "names")).alias("found"))
    joined = state.select("block", "base", "size", "data").join(found, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, block in _blocks_of(batch, plan):
                of = np.zeros(block.n, dtype=np.int64)
                found = batch.column("found")[k].as_py()
                for f in found:
                    if f["kind"] == 0:
                        of[sx.unpack_places(f["places"])] = sx.unpack(f["names"], "<i8")
                for f in found:
                    if f["kind"] == 1:
                        first, later = sx.unpack(f["places"], "<i4", 2).T
                        of[later] = of[first]
                places = np.flatnonzero(of)
                if len(places):
                    names = of[places]
                    yield table({
                        "block": ([block.number], pa.int64()), "base": ([block.base], _LONGS), "size": ([block.size], _LONGS), "data": ([sx.squeeze(block.thinned(places))], pa.binary()),
                        "places": ([sx.pack_places(places)], pa.binary()), "names": ([sx.pack(names)], pa.binary()),
                        "n": ([len(places)], pa.int64()), "n_hot": ([int((names >= HOT_BIT).sum())], pa.int64()),
                    })

    return joined.mapInArrow(run, STATE_SCHEMA)


# --- merging -----------------------------------------------------------------------------------

MET_SCHEMA = "part int, block long, n int, names binary, around binary, room binary, places binary"
MARKS_SCHEMA = "block long, places binary, shifts binary"


def _part_of(names: np.ndarray, old: int, new: int) -> np.ndarray:
    """Names come from ``old`` ranges; ``new`` ranges of whole ones, in the same order."""
    return ((names >> 32) & ((1 << 29) - 1)) * new // old


def _met(state: DataFrame, plan: sx.Plan, old: int, new: int, first: int, parts: int) -> DataFrame:
    """Samples with the bytes around them, by ranges of names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, block in _blocks_of(batch, plan):
                places, names = _named(batch, k)
                part = _part_of(names, old, new)
                here = np.flatnonzero((names < HOT_BIT) & (part >= first) & (part < first + parts))
                here = here[np.argsort(part[here], kind="stable")]
                places, names, part = places[here], names[here], part[here]
                before, ahead = block.room(places)
                around = np.concatenate([block.bytes_at(places - plan.around, plan.around), block.bytes_at(places + plan.depth, plan.around)], axis=1)
                room = np.minimum(np.stack([before, ahead - plan.depth], axis=1), plan.around).astype("<u2")
                head = np.flatnonzero(np.concatenate([np.ones(min(1, len(part)), dtype=bool), part[1:] != part[:-1]]))
                spans = list(zip(head.tolist(), [*head[1:].tolist(), len(part)])) if len(head) else []
                yield table({
                    "part": (part[head], pa.int32()), "block": ([block.number] * len(head), pa.int64()), "n": ([b - a for a, b in spans], pa.int32()),
                    "names": ([sx.pack(names[a:b]) for a, b in spans], pa.binary()), "around": ([sx.squeeze(around[a:b].tobytes()) for a, b in spans], pa.binary()),
                    "room": ([sx.pack(room[a:b]) for a, b in spans], pa.binary()), "places": ([sx.pack_places(places[a:b]) for a, b in spans], pa.binary()),
                })

    return state.mapInArrow(run, MET_SCHEMA)


def _merged(met: DataFrame, plan: sx.Plan) -> DataFrame:
    """The samples whose strings, at the given shifts, start earlier in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_part(batches):
            names = np.concatenate([sx.unpack(r["names"], "<i8") for r in rows])
            around = np.concatenate([np.frombuffer(sx.unsqueeze(r["around"]), dtype=np.uint8).reshape(-1, 2 * plan.around) for r in rows])
            before, after = np.concatenate([sx.unpack(r["room"], "<u2", 2) for r in rows]).T.astype(np.int64)
            again = sx.repeats_among(names, around[:, : plan.around], around[:, plan.around :], before, after)
            out, a = [], 0
            for r in rows:
                here = np.flatnonzero(again[a : a + r["n"]].any(axis=1))
                if len(here):
                    out.append((r["block"], sx.pack_places(sx.unpack_places(r["places"])[here]), sx.squeeze(np.packbits(again[a + here], axis=1).tobytes())))
                a += r["n"]
            block, places, shifts = zip(*out) if out else [()] * 3
            yield table({"block": (block, pa.int64()), "places": (places, pa.binary()), "shifts": (shifts, pa.binary())})

    return met.mapInArrow(run, MARKS_SCHEMA)


def _later(sent: DataFrame, key_bytes: int) -> DataFrame:
    """The strings of the ranges that start earlier in the corpus: all but the first of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_part(batches):
            out = [(r["block"], sx.pack_places(np.sort(sx.unpack(r["places"], "<i4", 2)[:, 1])), None) for r in rows if r["kind"] == 1]
            rows = [r for r in rows if r["kind"] == 0]
            if rows:
                met = _meeting(rows, key_bytes)
                first = np.zeros(len(met.group), dtype=bool)
                first[met.order[np.flatnonzero(np.diff(met.group[met.order], prepend=-1))]] = True
                for r, a, b in zip(rows, met.begin[:-1], met.begin[1:]):
                    at = a + np.flatnonzero(~first[a:b])
                    if len(at):
                        out.append((r["block"], sx.pack_places(np.sort(met.places[at])), None))
            block, places, shifts = zip(*out) if out else [()] * 3
            yield table({"block": (block, pa.int64()), "places": (places, pa.binary()), "shifts": (shifts, pa.binary())})

    return sent.mapInArrow(run, MARKS_SCHEMA)


REPEATS_SCHEMA = "doc long, row long, first long, count long"


def _repeats_of(marks: DataFrame, pieces: DataFrame, plan: sx.Plan) -> DataFrame:
    """(doc, row, first, count): runs of strings that start earlier in the corpus."""
    found = marks.groupBy("block").agg(F.collect_list(F.struct("places", "shifts")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                end = np.cumsum(r["size"])
                starts = np.zeros(int(end[-1]) + 2, dtype=np.int8)
                for f in r["found"]:
                    places = sx.unpack_places(f["places"])
                    if f["shifts"] is None:
                        starts[places + 1] = 1
                        continue
                    shifts = np.unpackbits(np.frombuffer(sx.unsqueeze(f["shifts"]), dtype=np.uint8).reshape(len(places), -1), axis=1, count=plan.around + 1)
                    sample, shift = np.nonzero(shifts)
                    starts[places[sample] - shift + 1] = 1
                edge = np.diff(starts)
                first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                piece = np.searchsorted(end, first, side="right")
                yield table({
                    "doc": (np.array(r["doc"])[piece], pa.int64()), "row": (np.array(r["row"])[piece], pa.int64()),
                    "first": (first - (end - r["size"])[piece] + np.array(r["base"])[piece], pa.int64()), "count": (stop - first, pa.int64()),
                })

    return pieces.join(found, "block").mapInArrow(run, REPEATS_SCHEMA)


# --- the sort ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Options:
    hot: int = HOT
    block_bytes: int = BLOCK_BYTES
    round_share: float = ROUND_SHARE


class SuffixSort:
    """One run over a corpus; tables that are done with go at once."""

    def __init__(self, keyed: DataFrame, scratch: Scratch, plan: sx.Plan, options: Options) -> None:
        self.scratch, self.plan, self.options = scratch, plan, options
        self.spark = keyed.sparkSession
        self.state = scratch.stash(text_blocks(keyed, plan.length, options.block_bytes), "blocks")
        self.pieces = scratch.stash(self.state.select("block", "doc", "row", "base", "size"), "pieces")
        self.text_bytes = self.state.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
        self.ranges = 1

    def _rounds(self, moved: float) -> tuple[int, int]:
        """Into how many rounds of how many ranges keys of so many bytes are dealt."""
        rounds = max(1, -(-int(moved) // max(1, int(self.options.round_share * self.text_bytes))))
        return rounds, max(self.spark.sparkContext.defaultParallelism, -(-int(moved) // (rounds * RANGE_BYTES)))

    def _dealt(self, level: Level, n_keys: int, answer: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
        """What ``answer`` makes of the keys of each range, round after round."""
        rounds, parts = self._rounds(n_keys * (level.key_bytes + 6))
        self.ranges = rounds * parts
        splits = _splitters(self.state, self.plan, level, n_keys, self.ranges)
        tables = [self.scratch.stash(answer(_ranges(_sent(self.state, self.plan, level, splits, r * parts, parts), r * parts, parts)), f"{label}-{r}") for r in range(rounds)]
        found = tables[0]
        for more in tables[1:]:
            found = found.unionByName(more)
        self._open = [f"{label}-{r}" for r in range(rounds)]
        return found

    def name(self, level: Level, n_keys: int, label: str, old: str) -> tuple[int, int]:
        named = self._dealt(level, n_keys, lambda sent: _names(sent, level.key_bytes, self.options.hot), label)
        self.state = self.scratch.stash(_carried(self.state, named, self.plan), f"{label}-state")
        self.scratch.drop(old, *self._open)
        return tuple(self.state.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_hot"), F.lit(0))).first())

    def repeats(self) -> DataFrame:
        plan, old = self.plan, "blocks"
        levels = [Level("letters", plan.width, plan.width)]
        for k in range(plan.recursions):
            width = plan.width + 2 * plan.stride * k
            levels.append(Level("triples", width, sx.triple_width(plan, width)))
        n, n_hot = int(self.text_bytes * sx.cover(plan.stride).mean()), 0
        for k, level in enumerate(levels):
            if n:
                n, n_hot = self.name(level, n, f"names-{k}", old)
                old = f"names-{k}-state"
        marks = []
        if n > n_hot:
            rounds, parts = self._rounds((n - n_hot) * (2 * plan.around + 12))
            for r in range(rounds):
                met = _ranges(_met(self.state, plan, self.ranges, rounds * parts, r * parts, parts), r * parts, parts)
                marks.append(self.scratch.stash(_merged(met, plan), f"merged-{r}"))
        if n_hot:
            level = Level("strings", plan.depth, plan.around + 8 + (1 if plan.around < 256 else 2))
            marks.append(self._dealt(level, n_hot * plan.stride, lambda sent: _later(sent, level.key_bytes), "strings"))
        found = marks[0] if marks else self.spark.createDataFrame([], MARKS_SCHEMA)
        for more in marks[1:]:
            found = found.unionByName(more)
        out = self.scratch.stash(_repeats_of(found, self.pieces, plan), "repeats")
        self.scratch.drop(old, "pieces")
        return out


def removed_spans(size: int, marks: list[int] | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the marked strings cover; a mark packs a first string and a count."""
    if not marks:
        return []
    packed = np.array(marks, dtype=np.int64)
    first, count = packed >> 24, packed & ((1 << 24) - 1)
    depth = np.zeros(size + 1, dtype=np.int64)
    np.add.at(depth, first, 1)
    np.add.at(depth, first + count - 1 + length, -1)
    covered = np.concatenate([[False], np.cumsum(depth[:-1]) > 0, [False]])
    return [(int(a), int(b)) for a, b in np.flatnonzero(covered[1:] != covered[:-1]).reshape(-1, 2)]


REPORT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def suffix_dedup_report(docs: DataFrame, length: int = LENGTH, options: Options = Options()) -> DataFrame:
    """For each document: its bytes, those removed with their spans, and the hash of what stays."""
    if not 0 < options.block_bytes < 1 << 24:
        raise ValueError("a block must be smaller than 16 MB")
    keyed, scratch = _keyed(docs), Scratch(docs.sparkSession, "suffix-dedup")
    with shuffles_dropped(docs.sparkSession):
        found = SuffixSort(keyed, scratch, sx.plan(length), options).repeats()
    marks = found.groupBy("doc", "row").agg(F.collect_list(F.shiftleft("first", 24).bitwiseOR(F.col("count"))).alias("marks"))
    joined = keyed.join(marks, ["doc", "row"], "left").select("doc_id", "text", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, marks in zip(raw(batch, "text"), batch.column("marks").to_pylist()):
                data = text or b""
                spans = removed_spans(len(data), marks, length)
                edges = [0, *[e for span in spans for e in span], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            yield table({
                "doc_id": (batch.column("doc_id"), pa.int64()), "n_bytes": ([o[0] for o in out], pa.int64()), "n_removed": ([o[1] for o in out], pa.int64()),
                "n_spans": ([len(o[2]) for o in out], pa.int64()), "kept_sha256": ([o[3] for o in out], pa.string()),
                "spans": ([[{"start": a, "end": b} for a, b in o[2]] for o in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            })

    return joined.mapInArrow(run, REPORT_SCHEMA)
