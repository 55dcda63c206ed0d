"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits, r even, have a point in common within r / 2 bits of
either. Every distinct fingerprint therefore emits all its variants within half
the radius; the variants are the shuffle key, and those met by several fingerprints give the links.
Exact copies share one fingerprint and take part once, so a large group of copies costs one row.

A bucket holds distinct fingerprints that all lie around one variant, which bounds it (65 for one
bit). Its members are linked to the smallest of them, and each link is verified: any two members of a
bucket of an even radius lie within it, so a star keeps the bucket connected without all its pairs.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; a null
``doc_id`` counts as the largest id, and a component of such rows only has a null id; repeated rows
fall together; an empty table gives an empty result; other columns are ignored by the report and
returned unchanged by ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from gritsieve.llm.arrow import raw, signed, spare, table
from gritsieve.operators.components import connected_components
from gritsieve.scratch import Scratch

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of the word shingles, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), BLOCK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK])], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, row, fp): ``row`` tells rows of one id apart by their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw(batch, "text")
            yield table({
                "doc_id": (batch.column("doc_id"), pa.int64()),
                "row": (batch.column("row"), pa.int64()),
                "fp": ([signed(fingerprint(t, shingle, seed)) for t in texts], pa.int64()),
            })

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("row"), docs["text"].alias("text"))
    return slim.mapInArrow(run, "doc_id long, row long, fp long")


def ball(bits: int) -> list[int]:
    """All masks of at most ``bits`` of 64 bits."""
    return [signed(sum(1 << b for b in chosen)) for k in range(bits + 1) for chosen in combinations(range(64), k)]


def near_links(classes: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """(a, b): links among distinct fingerprints that keep every pair within the radius connected."""
    if radius % 2:
        raise ValueError("the radius must be even: half of it is flipped on either side")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius - radius // 2)])
    variants = classes.select("fp", F.explode(masks).alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp")
    # plain counters first: few variants are met twice, and only those gather their members
    met = variants.groupBy("variant").agg(F.count("*").alias("n"), F.min("fp").alias("a")).where("n > 1").select("variant", "a")
    stars = variants.join(scratch.stash(met, "met"), "variant").select("a", F.col("fp").alias("b"))
    near = stars.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    return scratch.stash(near.distinct(), "links")


def _grouped(docs: DataFrame, scratch: Scratch, radius: int, shingle: int, seed: int) -> DataFrame:
    """(doc_id, row, fp, head): ``head`` is the (id, row) of the first document of the group."""
    prints = scratch.stash(fingerprints(docs, shingle, seed), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("row").alias("row"))).alias("first")
    classes = scratch.stash(prints.groupBy("fp").agg(first), "classes")
    roots = connected_components(near_links(classes.select("fp"), radius, scratch), scratch)
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.stash(rooted, "rooted")
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"))
    named = scratch.stash(rooted.join(heads, "root").select("fp", "head"), "named")
    return prints.join(named, "fp")


def simhash_report(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """For each document: its fingerprint in hex and the smallest id of its group."""
    rows = _grouped(docs, Scratch(docs.sparkSession, "simhash"), radius, shingle, seed)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("head.id").alias("component_id"))


def dedup(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One document of each group, that of the smallest id, with all its columns."""
    scratch = Scratch(docs.sparkSession, "simhash-dedup")
    rows = _grouped(docs, scratch, radius, shingle, seed)
    keys = of, none, row = spare(docs.columns, "id", "none", "row")
    heads = rows.select(F.coalesce("head.id", F.lit(0)).alias(of), F.col("head.last").alias(none), F.col("head.row").alias(row)).distinct()
    own = docs["doc_id"].cast("long")
    keyed = docs.withColumns({of: F.coalesce(own, F.lit(0)), none: own.isNull(), row: F.xxhash64(docs["text"])})
    return keyed.join(scratch.stash(heads, "heads"), list(keys), "left_semi").dropDuplicates(list(keys)).select(*[F.col(f"`{c}`") for c in docs.columns])
