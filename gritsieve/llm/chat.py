"""Chat formatting by quotation linking.

Every message is parsed into quote levels: its own lines, and passages of lines that stand behind one
or more quote marks. Own text and quoted passages are normalised and hashed; a quoted passage is
joined to the message of the same conversation that wrote it, the latest before the quoting one. The
best linked passage of the lowest level names the message that is answered; a message without such a
passage answers the turn before it. The result is each message without quotes, with its place in the
reply tree; ``conversations`` has them in reply order, formatted for training.

"The latest before" is an as-of join in two levels: rows are combined by (conversation, hash, turn),
so a passage that very many messages share is one row from each task, and windows run inside buckets
of turns, with one carried row for each bucket. No pair of messages is ever formed.

Defined results: a null text is an empty message; a message whose ``conv_id`` or ``turn`` is null has
no parent and depth 0; messages with one (conv_id, turn) are siblings: none answers another, and the
turn answers the latest turn that any of them answers; repeated rows each give their own result; an
empty table gives an empty result; quotes of texts that are not in the conversation stay unlinked and
are removed all the same; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from gritsieve.llm.arrow import raw, table
from gritsieve.scratch import Scratch

#: Turns that one window partition may hold.
BUCKET = 512
#: Quote marks at the start of a line, and lines that only announce a quote (fixed values).
MARKS = re.compile(rb"[ \t]*((?:>[ \t]?)+)")
ANNOUNCES = re.compile(rb"(?i)^\s*(?:on\b.{0,200}\bwrote|le\b.{0,200}a \xc3\xa9crit|am\b.{0,200}schrieb.{0,100}|el\b.{0,200}escribi\xc3\xb3)\s*:\s*$")


class Passage(NamedTuple):
    level: int
    lines: list[bytes]


def parse(text: bytes | None) -> list[Passage]:
    """Runs of lines of one quote level; level 0 is the message's own text."""
    passages: list[Passage] = []
    for line in (text or b"").split(b"\n"):
        mark = MARKS.match(line)
        level = mark[1].count(b">") if mark else 0
        body = line[mark.end() :] if mark else line
        if passages and passages[-1].level == level:
            passages[-1].lines.append(body)
        else:
            passages.append(Passage(level, [body]))
    return passages


def own_text(passages: list[Passage]) -> bytes:
    """The unquoted lines, without announcements of quotes, outer blank lines and runs of blank lines."""
    kept: list[bytes] = []
    for k, passage in enumerate(passages):
        if passage.level:
            continue
        lines = list(passage.lines)
        if k + 1 < len(passages):
            while lines and not lines[-1].strip():
                lines.pop()
            if lines and ANNOUNCES.match(lines[-1]):
                lines.pop()
        kept += lines
    return re.sub(rb"\n(?:[ \t\r]*\n)+", b"\n\n", b"\n".join(kept)).strip()


def normalise(lines: list[bytes]) -> bytes:
    return b" ".join(b"\n".join(lines).lower().split())


def units(lines: list[bytes]) -> set[bytes]:
    """The normalised passage as a whole, its paragraphs and its lines: any of them may be quoted."""
    text = b"\n".join(lines)
    found = {normalise([text])} | {normalise([p]) for p in re.split(rb"\n[ \t\r]*\n", text)} | {normalise([line]) for line in lines}
    found.discard(b"")
    return found


def _halves(units: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, units)), dtype="<i8").reshape(-1, 2)


UNITS_SCHEMA = "conv_id long, turn long, quoted boolean, level int, size int, h1 long, h2 long"


def passage_units(messages: DataFrame) -> DataFrame:
    """Hashed units of own texts and of quoted passages; ``size`` is the unit's length in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, bool, int, bytes]] = []
            for k, text in enumerate(raw(batch, "text")):
                passages = parse(text)
                if any(p.level for p in passages):
                    rows += [(k, True, p.level, u) for p in passages if p.level for u in sorted(units(p.lines))]
                rows += [(k, False, 0, u) for u in sorted(units(own_text(passages).split(b"\n")))]
            at, halves = pa.array([r[0] for r in rows], pa.int64()), _halves([r[3] for r in rows])
            yield table({
                "conv_id": (batch.column("conv_id").take(at), pa.int64()), "turn": (batch.column("turn").take(at), pa.int64()),
                "quoted": ([r[1] for r in rows], pa.bool_()), "level": ([r[2] for r in rows], pa.int32()), "size": ([len(r[3]) for r in rows], pa.int32()),
                "h1": (np.ascontiguousarray(halves[:, 0]), pa.int64()), "h2": (np.ascontiguousarray(halves[:, 1]), pa.int64()),
            })

    return messages.where("conv_id is not null and turn is not null").mapInArrow(run, UNITS_SCHEMA)


def latest_before(rows: DataFrame, keys: list[str], bucket: int = BUCKET) -> DataFrame:
    """For rows (keys, turn, own, asked), one for each key and turn: the latest ``turn`` before it that is ``own``."""
    rows = rows.withColumn("part", F.floor(F.col("turn") / bucket))
    before = Window.partitionBy(*keys, "part").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("near", F.max(F.when(F.col("own"), F.col("turn"))).over(before))
    parts = rows.groupBy(*keys, "part").agg(F.max(F.when(F.col("own"), F.col("turn"))).alias("last"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("carried", F.max("last").over(earlier)).select(*keys, "part", "carried")
    found = rows.where("asked").join(parts, [*keys, "part"]).withColumn("found", F.coalesce("near", "carried"))
    return found.select(*keys, "turn", "found")


def _depths(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, thread, depth) by pointer doubling over (conv_id, turn, parent)."""
    open_ = F.col("parent").isNotNull()
    known = parents.select("conv_id", "turn", F.coalesce("parent", "turn").alias("up"), open_.cast("long").alias("depth"), open_.alias("open"))
    known, step = scratch.stash(known, "depth-0"), 0
    while known.where("open").limit(1).count():
        # only turns that have not reached their root go on
        above = known.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more"))
        jumped = known.where("open").join(above, ["conv_id", "up"])
        jumped = jumped.select("conv_id", "turn", F.col("top").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("open"))
        step += 1
        known = scratch.stash(known.where("not open").unionByName(jumped), f"depth-{step}")
        scratch.drop(f"depth-{step - 1}")
    return known.select("conv_id", "turn", F.col("up").alias("thread"), "depth")


def link_quotes(messages: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(conv_id, turn, parent, by_quote, thread, depth), one row for each turn of each conversation."""
    scratch = Scratch(messages.sparkSession, "chat")
    slim = messages.select(messages["conv_id"].cast("long").alias("conv_id"), messages["turn"].cast("long").alias("turn"), messages["text"].alias("text"))
    found = scratch.stash(passage_units(slim), "units")
    quoted = found.where("quoted").groupBy("conv_id", "h1", "h2", "turn").agg(F.lit(False).alias("own"), F.lit(True).alias("asked"))
    asked = quoted.select("conv_id", "h1", "h2").distinct()
    own = found.where("not quoted").join(asked, ["conv_id", "h1", "h2"], "left_semi").groupBy("conv_id", "h1", "h2", "turn").agg(F.lit(True).alias("own"), F.lit(False).alias("asked"))
    both = own.unionByName(quoted).groupBy("conv_id", "h1", "h2", "turn").agg(F.bool_or("own").alias("own"), F.bool_or("asked").alias("asked"))
    linked = latest_before(both, ["conv_id", "h1", "h2"], bucket).where("found is not null")
    # the lowest level first, then the most quoted bytes, then the latest message
    best = found.where("quoted").join(linked, ["conv_id", "h1", "h2", "turn"]).groupBy("conv_id", "turn", "level", "found").agg(F.sum("size").alias("bytes"))
    best = best.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("near"), "bytes", "found"))["found"].alias("quoted_turn"))
    turns = slim.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.lit(True).alias("own"), F.lit(True).alias("asked"))
    previous = latest_before(turns, ["conv_id"], bucket).select("conv_id", "turn", F.col("found").alias("previous"))
    parents = previous.join(best, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("quoted_turn", "previous").alias("parent"), F.col("quoted_turn").isNotNull().alias("by_quote"))
    parents = scratch.stash(parents, "parents")
    return parents.join(_depths(parents, scratch), ["conv_id", "turn"])


def _places(links: DataFrame, bucket: int) -> DataFrame:
    """``links`` with ``place``: the number of the turn in its conversation's thread, in reply order.

    A message answers an earlier turn, so by turn every reply stands after what it answers. The count
    runs in two levels: inside buckets of turns, and over one row for each bucket.
    """
    rows = links.withColumn("part", F.floor(F.col("turn") / bucket))
    near = F.row_number().over(Window.partitionBy("conv_id", "thread", "part").orderBy("turn"))
    parts = rows.groupBy("conv_id", "thread", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id", "thread").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "thread", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("carried"))
    return rows.withColumn("near", near).join(parts, ["conv_id", "thread", "part"]).withColumn("place", (F.col("carried") + F.col("near") - 1).cast("long")).drop("part", "near", "carried")


def clean(text: Column) -> Column:
    """The message without quotes, as (text, quoted passages, deepest level)."""

    @F.arrow_udf("struct<text:string,n_quotes:long,quote_depth:long>")
    def parsed(texts: pa.Array) -> pa.Array:
        values = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()
        found = [parse(v) for v in values]
        own = pa.array([own_text(p) for p in found], pa.binary()).cast(pa.string())
        counts = pa.array([sum(x.level > 0 for x in p) for p in found], pa.int64())
        deepest = pa.array([max((x.level for x in p), default=0) for p in found], pa.int64())
        return pa.StructArray.from_arrays([own, counts, deepest], ["text", "n_quotes", "quote_depth"])

    return parsed(text)


def format_chats(messages: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Every message without its quotes, and where it stands in its reply-ordered conversation."""
    links = _places(link_quotes(messages, bucket), bucket)
    links = links.select(F.col("conv_id").alias("__conv"), F.col("turn").alias("__turn"), "parent", "by_quote", "thread", "depth", "place")
    rows = messages.select(messages["conv_id"].cast("long").alias("conv_id"), messages["turn"].cast("long").alias("turn"), messages["role"].alias("role"), clean(messages["text"]).alias("own"))
    joined = rows.join(links, (F.col("conv_id") == F.col("__conv")) & (F.col("turn") == F.col("__turn")), "left")
    link = F.when(F.col("parent").isNull(), "root").when(F.col("by_quote"), "quote").otherwise("previous")
    return joined.select(
        "conv_id", "turn", "role", F.col("parent").alias("reply_to"), link.alias("link"), F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("place", F.lit(0)).cast("long").alias("place"), F.col("own.n_quotes").alias("n_quotes"), F.col("own.quote_depth").alias("quote_depth"), F.col("own.text").alias("text"),
    )


def conversations(messages: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The conversations as rows (conv_id, thread, place, role, formatted), sorted: each turn as its role, a newline and its text.

    Rows stay rows, however long a conversation is; sorting deals them out by range.
    """
    chats = format_chats(messages, bucket).where("conv_id is not null and turn is not null")
    formatted = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.coalesce("text", F.lit("")))
    return chats.select("conv_id", "thread", "place", "role", formatted.alias("formatted")).orderBy("conv_id", "thread", "place", "role")


def chat_report(messages: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The formatted messages with a hash in place of the text."""
    chats = format_chats(messages, bucket)
    return chats.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256)).drop("text")
