"""N-gram Jaccard join with a token-group matrix.

A document is the set of its five-word shingles, as 64-bit tokens. Equal sets are one class, and one row of
each class takes part. The join is exact and runs in these steps:

1. **Order of the tokens.** Tasks count 32-bit slots of tokens in sorted blocks, merged by ranges. The ``heavy``
   slots held by most documents come last; all others by value. Any order gives the same links, this one few candidates.
2. **Matrix of tokens.** Two sets with similarity t share k of the first ``n - ceil(t n) + k`` tokens of either, in
   any common order (k is ``SHARED``, less for sets that need not share as many). These tokens are the matrix. Heavy ones are
   joined by Spark, the others come in sorted blocks, so no range gathers a hot token.
3. **Groups.** Classes with the same least token under a second hash are likely similar. Such a partition is cut to
   groups of bounded size. Every class is compared with the first of its partition, which joins most copies at once;
   the firsts meet again by a third hash.
4. **Bounds.** A class is a query to a group where it shares k tokens of the matrix with the group's union, save
   where both are joined already: among the classes of a token, those of the largest component need not ask.
   Where the query's overlap with the union of all tokens of the group is below what a link needs, the group
   stays closed; the others are opened and every member is compared. Texts travel to their groups once.
5. Components of the links come from alternating stars.

``jaccard_links(..., every=True)`` leaves out the shortcut of steps 3 and 4 and returns every pair of linked classes.

Defined results: a null, empty or wordless text has an empty set and is linked with nothing, its component is its own id;
a text of fewer than five words is one shingle; a null ``doc_id`` counts as the largest id, and a component of such
rows only has a null id; rows that repeat an id are documents of their own; an empty table gives an empty result; other
columns are ignored by the report and returned unchanged by ``dedup_similar``. Tokens are 64-bit hashes: that two shingles
of two compared sets share one by chance has odds of one in 10^19 for each pair of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from gritsieve.llm.arrow import raw, signed, spare, table
from gritsieve.llm.words import Memo
from gritsieve.operators.components import connected_components
from gritsieve.scratch import Scratch

SHINGLE = 5
PERCENT = 80
#: Slots that are ordered last: how many at most, and in how many documents at least (an order, not a limit on rows).
HEAVY = 1 << 20
HEAVY_ROWS = 8
#: Members and tokens that a group holds on average, at most; queries sent to a group together.
GROUP = 64
GROUP_TOKENS = 1 << 18
#: Tokens of the matrix that two linked sets share at least; more of them leave fewer candidates and make it larger.
SHARED = 4
#: Tokens of one sorted block, and of one range of blocks; slots are merged in 2^SLOT_BITS ranges.
BLOCK = 1 << 22
RANGE = 1 << 21
SLOT_BITS = 6
#: Bits of the filter ahead of the join that gives texts their places.
FILTER_BITS = 1 << 24
LABELS = 2

_ODD = [np.uint64(2 * (0x9E3779B97F4A7C15 * (k + 1) % (1 << 63)) + 1) for k in range(64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of a splittable generator)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sorted distinct tokens of texts; remembers the hashes of words, up to a bound."""

    def __init__(self, shingle: int) -> None:
        self.shingle, self._words = shingle, Memo(lambda w: xxhash.xxh64_intdigest(w, 5))

    def of(self, text: bytes | None) -> np.ndarray:
        words = self._words.array((text or b"").lower())
        k = min(self.shingle, len(words))
        if not k:
            return words
        with np.errstate(over="ignore"):
            total = np.full(len(words) - k + 1, k, dtype=np.uint64)
            for j in range(k):
                total += words[j : len(words) - k + 1 + j] * _ODD[j]
        return np.unique(_mixed(total))


def least_overlap(n: int, percent: int) -> int:
    """Tokens that a set of ``n`` shares with any set at least so similar."""
    return -(-percent * n // 100)


def linked(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def _packed(values: np.ndarray) -> bytes:
    """A sorted or small array as compressed planes of bytes of its differences."""
    kind = values.dtype
    steps = np.diff(values, prepend=kind.type(0))
    return zstandard.compress(steps.view(np.uint8).reshape(-1, kind.itemsize).T.tobytes(), 1)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.cumsum(planes.T.copy().reshape(-1).view(kind), dtype=kind)


def _rows(docs: DataFrame, shingle: int, scratch: Scratch) -> DataFrame:
    """(row, doc_id, n, d1, d2, labels, text): ``row`` is a number of its own, d1 and d2 a digest of the set.

    The same pass counts slots of tokens: rows without a ``row`` are sorted blocks of (slot, count), cut to ``range``s.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, slots, size = Shingles(shingle), [], 0
        names = ("row", "doc_id", "n", "d1", "d2", "labels", "text", "range", "slots", "counts")
        kinds = (*[pa.int64()] * 5, pa.list_(pa.int64()), pa.string(), pa.int32(), pa.binary(), pa.binary())

        def rows(length: int, **columns: object) -> pa.RecordBatch:
            return table({name: (columns.get(name, [None] * length), kind) for name, kind in zip(names, kinds)})

        def counted() -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate(slots), return_counts=True)
            edges = np.searchsorted(found, np.arange(1, 1 << SLOT_BITS, dtype=np.uint64) << np.uint64(32 - SLOT_BITS))
            parts = [(k, s, c) for k, (s, c) in enumerate(zip(np.split(found, edges), np.split(counts.astype(np.uint32), edges))) if len(s)]
            return rows(len(parts), range=[p[0] for p in parts], slots=[_packed(p[1]) for p in parts], counts=[_packed(p[2]) for p in parts])

        for batch in batches:
            found = []
            for text in raw(batch, "text"):
                tokens = of.of(text)
                digest = xxhash.xxh3_128_intdigest(tokens.tobytes())
                labels = [signed(int(_mixed(tokens ^ np.uint64(seed + 1)).min())) for seed in range(LABELS)] if len(tokens) else None
                found.append((len(tokens), signed(digest >> 64), signed(digest & (1 << 64) - 1), labels))
                slots.append((tokens >> np.uint64(32)).astype(np.uint32))
                size += len(tokens)
                if size >= BLOCK:
                    yield counted()
                    slots, size = [], 0
            n, d1, d2, labels = zip(*found) if found else ((), (), (), ())
            yield rows(batch.num_rows, row=batch.column("row"), doc_id=batch.column("doc_id"), n=n, d1=d1, d2=d2, labels=labels, text=batch.column("text"))
        if size:
            yield counted()

    slim = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    schema = "row long, doc_id long, n long, d1 long, d2 long, labels array<long>, text string, range int, slots binary, counts binary"
    return scratch.stash(slim.mapInArrow(run, schema), "rows", compression="zstd")


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted slots and their counts of several such pairs."""
    slots, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(slots, kind="stable")
    slots, counts = slots[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
    return slots[first], np.add.reduceat(counts, first)


def _heavy(blocks: DataFrame, heavy: int, heavy_rows: int, scratch: Scratch) -> np.ndarray:
    """The sorted slots that most documents hold, at most ``heavy`` of them."""

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # each range gathers its blocks in halves: what is merged has about the size of what is added to it
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for s, c in zip(batch.column("slots"), batch.column("counts")):
                held.append((_unpacked(s.as_py(), np.uint32), _unpacked(c.as_py(), np.uint32).astype(np.int64)))
                while len(held) > 1 and len(held[-2][0]) <= 2 * len(held[-1][0]):
                    held.append(_summed([held.pop(), held.pop()]))
        slots, counts = _summed(held)
        keep = counts >= heavy_rows
        yield table({"slot": (slots[keep].astype(np.int64), pa.int64()), "n": (counts[keep], pa.int64())})

    top = scratch.stash(blocks.groupBy("range").applyInArrow(merge, "slot long, n long"), "heavy").orderBy(F.desc("n"), "slot").limit(heavy).select("slot").toArrow()
    return np.sort(top.column("slot").to_numpy().astype(np.uint32))


def _first_tokens(tokens: np.ndarray, heavy: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The tokens of the matrix of one set, and how many of them are not heavy; those come first."""
    need = least_overlap(len(tokens), percent)
    most = len(tokens) - need + min(SHARED, need)
    last = np.zeros(len(tokens), dtype=bool)
    if len(heavy):
        slots = (tokens >> np.uint64(32)).astype(np.uint32)
        last = heavy[np.minimum(np.searchsorted(heavy, slots), len(heavy) - 1)] == slots
    light = tokens[~last][:most]
    return np.concatenate([light, tokens[last][: most - len(light)]]), len(light)


def _met(rows: DataFrame, classes: DataFrame, heavy: np.ndarray, shingle: int, percent: int, scratch: Scratch) -> DataFrame:
    """(token, row): tokens of the matrix that several classes hold, with these."""
    shared = rows.sparkSession.sparkContext.broadcast(heavy)
    tokens = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(0, int(-(-tokens * (100 - percent) // 100 // RANGE)).bit_length())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, light, loud, size = Shingles(shingle), [], [], 0

        def flush() -> pa.RecordBatch:
            parts = []
            if light:
                values = np.concatenate([t for t, _ in light])
                owners = np.repeat(np.array([r for _, r in light], dtype=np.int64), [len(t) for t, _ in light])
                order = np.argsort(values, kind="stable")
                values, owners = values[order], owners[order]
                edges = np.searchsorted(values, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
                parts = [(k, _packed(v), _packed(o), None, None) for k, (v, o) in enumerate(zip(np.split(values, edges), np.split(owners, edges))) if len(v)]
            for t, r in loud:
                parts.append((None, None, None, t.view(np.int64), r))
            names = zip(("range", "tokens", "rows", "loud", "row"), (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64()))
            return table({name: ([p[k] for p in parts], kind) for k, (name, kind) in enumerate(names)})

        for batch in batches:
            for text, row in zip(raw(batch, "text"), batch.column("row").to_pylist()):
                tokens = of.of(text)
                if len(tokens):
                    first, n = _first_tokens(tokens, shared.value, percent)
                    light.append((first[:n], row))
                    if n < len(first):
                        loud.append((first[n:], row))
                    size += len(first)
                if size >= BLOCK:
                    yield flush()
                    light, loud, size = [], [], 0
        if size:
            yield flush()

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(_unpacked(t.as_py(), np.uint64), _unpacked(r.as_py(), np.int64)) for b in batches for t, r in zip(b.column("tokens"), b.column("rows"))]
        values, owners = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(values, kind="stable")
        values, owners = values[order], owners[order]
        same = values[1:] == values[:-1]
        several = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        yield table({"token": (values[several].view(np.int64), pa.int64()), "row": (owners[several], pa.int64())})

    found = scratch.stash(rows.select("row", "text").mapInArrow(blocks, "range int, tokens binary, rows binary, loud array<long>, row long"), "first-tokens", compression="zstd")
    quiet = found.where("range is not null").select("range", "tokens", "rows").groupBy("range").applyInArrow(merge, "token long, row long")
    loud = found.where("range is null").select(F.explode("loud").alias("token"), "row")
    held = scratch.stash(quiet.unionByName(loud).join(classes.select("row"), "row", "left_semi"), "held")
    scratch.drop("first-tokens")
    several = held.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    return scratch.stash(held.join(several, "token"), "met")


def _linkable(met: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``met`` with ``n`` of each class that has as many shared tokens as a link needs."""
    counts = met.groupBy("row").agg(F.count("*").alias("held")).join(classes.select("row", "n"), "row")
    return met.join(counts.where(F.col("held") >= _shared(F.col("n"), percent)).select("row", "n"), "row")


def _shared(n: Column, percent: int) -> Column:
    """How many tokens of the matrix a set of ``n`` shares with any that it is linked to."""
    return F.least(F.lit(SHARED), F.ceil(percent * n / F.lit(100)))


def _tokens(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=np.uint64)


def _parts(n_rows: Column, n_tokens: Column) -> Column:
    """Into how many groups a partition of so many rows and tokens is cut."""
    return F.greatest(F.lit(1), F.ceil(n_rows / GROUP), F.ceil(n_tokens / GROUP_TOKENS)).cast("int")


def _partitioned(members: DataFrame, kind: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(row, n, label, c, lead, grp) of each class, and (label, c, lead, parts) of each partition by a label."""
    label = F.get("labels", F.lit(kind))
    sizes = members.groupBy(label.alias("label")).agg(F.count("*").alias("c"), _parts(F.count("*"), F.sum("n")).alias("parts"), F.min("row").alias("lead"))
    sizes = scratch.stash(sizes, f"sizes-{kind}")
    grp = F.xxhash64(F.lit(kind), "label", F.pmod(F.xxhash64("row"), F.col("parts")))
    return scratch.stash(members.withColumn("label", label).join(sizes, "label").select("row", "n", "labels", "c", "lead", grp.alias("grp")), f"groups-{kind}"), sizes


def _to_firsts(groups: DataFrame, sizes: DataFrame, kind: int) -> DataFrame:
    """(row, grp, part, asks): classes that share a partition, and the first of it, which goes to each of its groups."""
    members = groups.where("c > 1").select("row", "grp", F.lit(0).alias("part"), F.lit(False).alias("asks"))
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    firsts = sizes.where("c > 1").select(F.col("lead").alias("row"), "label", part)
    return members.unionByName(firsts.select("row", F.xxhash64(F.lit(kind), "label", F.col("part").cast("long")).alias("grp"), F.lit(0).alias("part"), F.lit(True).alias("asks")))


def _likely(texts: DataFrame, places: DataFrame) -> DataFrame:
    """(row, text) without most rows that have no place, so that their texts are not shuffled for nothing.

    A bitmap of fixed size marks the hashes of the rows that have one: at most FILTER_BITS / 64 words pass through
    the driver. What it lets through is decided by the join that follows.
    """
    slot = F.pmod(F.xxhash64("row"), F.lit(FILTER_BITS))
    words = places.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(row), {FILTER_BITS}) % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    marks = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    marks[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(np.unpackbits(marks.view(np.uint8), bitorder="little"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = shared.value[batch.column("slot").to_numpy()].astype(bool)
            yield batch.select(["row", "text"]).filter(pa.array(keep))

    return texts.withColumn("slot", slot).mapInArrow(run, "row long, text string")


def _compared(rows: DataFrame, places: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b, both): links between the sets that ask and the members of the group at the same (grp, part).

    ``places``: (row, grp, part, asks). Texts travel there once; tokens are made there.
    """

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, asking, members, found = Shingles(shingle), [], [], []
        for batch in batches:
            for row, asks, text in zip(batch.column("row").to_pylist(), batch.column("asks").to_pylist(), raw(batch, "text")):
                (asking if asks else members).append((row, of.of(text)))
        every = np.unique(np.concatenate([t for _, t in members])) if members else np.zeros(0, np.uint64)
        for row, query in asking:
            if common(query, every) < least_overlap(len(query), percent):
                continue  # no member can be similar enough: the group stays closed
            for other, tokens in members:
                small, large = sorted((len(query), len(tokens)))
                if other != row and 100 * small >= percent * large and linked(small, large, both := common(query, tokens), percent):
                    found.append((min(row, other), max(row, other), both))
        a, b, both = zip(*found) if found else ((), (), ())
        yield table({"a": (a, pa.int64()), "b": (b, pa.int64()), "both": (both, pa.int64())})

    texts = _likely(rows.select("row", "text"), places).join(places, "row").select("grp", "part", "row", "asks", "text")
    return texts.groupBy("grp", "part").applyInArrow(run, "a long, b long, both long").distinct()


def _asked(wanted: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, grp, part, asks): queries (row, size, grp) in blocks, each of which meets the members of its group."""
    sizes = scratch.stash(wanted.groupBy("grp").agg(_parts(F.count("*"), F.sum("size")).alias("parts")), "query-sizes")
    asking = wanted.join(sizes, "grp").select("row", "grp", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("asks"))
    members = groups.select("row", "grp").join(sizes, "grp").select("row", "grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"))
    return scratch.stash(asking.unionByName(members), "asked")


def _links(docs: DataFrame, shingle: int, percent: int, every: bool, scratch: Scratch, heavy: int, heavy_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links): see the module; without ``every``, links enough to join all components."""
    table_ = _rows(docs, shingle, scratch)
    rows = table_.where("row is not null").select("row", "doc_id", "n", "d1", "d2", "labels", "text")
    slim = rows.where("n > 0").select("d1", "d2", F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), "row", "n", "labels").alias("at"))
    classes = scratch.stash(slim.groupBy("d1", "d2").agg(F.min("at").alias("at")).select("d1", "d2", "at.*"), "classes")
    slots = _heavy(table_.where("row is null").select("range", "slots", "counts"), heavy, heavy_rows, scratch)
    met = scratch.stash(_linkable(_met(rows, classes, slots, shingle, percent, scratch), classes, percent), "linkable")
    groups, sizes = _partitioned(classes.select("row", "n", "labels").join(met.select("row").distinct(), "row", "left_semi"), 0, scratch)
    held, near = met.join(groups.select("row", "grp"), "row"), None
    if every:
        held = held.withColumn("comp", F.col("row"))
    else:
        firsts = groups.where("row = lead").select("row", "n", "labels")
        places = scratch.stash(_to_firsts(groups, sizes, 0).unionByName(_to_firsts(*_partitioned(firsts, 1, scratch), 1)), "places")
        near = scratch.stash(_compared(rows, places, shingle, percent).select("a", "b"), "near")
        roots = connected_components(near, scratch)
        held = held.join(roots, held["row"] == roots["node"], "left").select(*[held[c] for c in held.columns], F.coalesce("root", "row").alias("comp"))
    held = scratch.stash(held, "matrix")
    per = held.groupBy("token", "comp").agg(F.count("*").alias("c"))
    major = per.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("major"), F.count("*").alias("comps")).where("comps > 1").select("token", "major")
    mixed = scratch.stash(held.join(major, "token"), "mixed")
    # members of the token's largest component are found by the others, so they need not ask
    asking = mixed.where("comp <> major").select("token", "row", F.col("comp").alias("own"), F.col("n").alias("size"))
    spread = mixed.groupBy("token", "grp").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
    fits = (100 * F.col("size") >= percent * F.col("low")) & (100 * F.col("high") >= percent * F.col("size")) & ((F.col("own") != F.col("c1")) | (F.col("own") != F.col("c2")))
    met_at = asking.join(spread, "token").where(fits).groupBy("row", "size", "grp").agg(F.count("*").alias("shared"), F.min("low").alias("low"))
    # a link needs SHARED tokens of the matrix in common, or all that the smaller set must share
    wanted = scratch.stash(met_at.where(F.col("shared") >= _shared(F.least("size", "low"), percent)).select("row", "size", "grp"), "wanted")
    found = scratch.stash(_compared(rows, _asked(wanted, groups, scratch), shingle, percent), "found")
    return rows, classes, found.select("a", "b").unionByName(near) if near is not None else found


def jaccard_links(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(a, b, n_both): every pair of linked classes, by the smallest ids of their documents; equal sets are one class."""
    _, classes, links = _links(docs, shingle, percent, True, Scratch(docs.sparkSession, "jaccard-links"), HEAVY, HEAVY_ROWS)
    name = lambda c: classes.select(F.col("row").alias(c), F.col("id").alias(f"{c}_id"))
    told = links.join(name("a"), "a").join(name("b"), "b")
    return told.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), F.col("both").alias("n_both"))


def _components(docs: DataFrame, shingle: int, percent: int, scratch: Scratch, heavy: int, heavy_rows: int) -> DataFrame:
    """(row, doc_id, n, head): ``head`` is (last, id, row) of the first document of the component; null for an empty set."""
    rows, classes, links = _links(docs, shingle, percent, False, scratch, heavy, heavy_rows)
    roots = connected_components(links, scratch)
    rooted = classes.join(roots, classes["row"] == roots["node"], "left").select("d1", "d2", F.struct("last", "id", "row").alias("at"), F.coalesce("root", "row").alias("root"))
    rooted = scratch.stash(rooted, "rooted")
    heads = rooted.groupBy("root").agg(F.min("at").alias("head"))
    named = scratch.stash(rooted.join(heads, "root").select("d1", "d2", "head"), "named")
    narrow = rows.select("row", "doc_id", "n", "d1", "d2")
    full = narrow.where("n > 0").join(named, ["d1", "d2"]).select("row", "doc_id", "n", "head")
    return full.unionByName(narrow.where("n = 0").select("row", "doc_id", "n", F.lit(None).cast(named.schema["head"].dataType).alias("head")))


def jaccard_report(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, heavy: int = HEAVY, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """For each document: the size of its set and the smallest id of its component."""
    rows = _components(docs, shingle, percent, Scratch(docs.sparkSession, "jaccard"), heavy, heavy_rows)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.id")).alias("component_id"))


def dedup_similar(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each component, that of the smallest id, with all its columns; rows with an empty set stay.

    Of rows that repeat an id and a text, one stays.
    """
    scratch = Scratch(docs.sparkSession, "jaccard-dedup")
    rows = _components(docs, shingle, percent, scratch, HEAVY, HEAVY_ROWS)
    of, none, digest = spare(docs.columns, "id", "none", "digest")
    gone = rows.where(F.col("head").isNotNull() & (F.col("row") != F.col("head.row")))
    kept = scratch.stash(rows.join(gone.select("row"), "row", "left_anti").select("row"), "kept")
    texts = scratch.spark.read.parquet(scratch.path("rows")).select("row", "doc_id", F.xxhash64("text").alias(digest)).join(kept, "row", "left_semi")
    keys = texts.select(F.coalesce("doc_id", F.lit(0)).alias(of), F.col("doc_id").isNull().alias(none), digest).distinct()
    own = docs["doc_id"].cast("long")
    keyed = docs.withColumns({of: F.coalesce(own, F.lit(0)), none: own.isNull(), digest: F.xxhash64(docs["text"])})
    return keyed.join(keys, [of, none, digest], "left_semi").dropDuplicates([of, none, digest]).select(*[F.col(f"`{c}`") for c in docs.columns])
