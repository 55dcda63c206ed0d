"""Token counts by a separator scan over flat token files.

A token file is a plain sequence of little-endian identifiers in which each document ends with the
end-of-document identifier; there is no index. The scan cuts files into blocks of fixed size, finds
the separators of a block with one vectorised comparison, and reports what lies before its first and
after its last separator. A prefix scan over these block summaries stitches the documents that cross
blocks and numbers them within their file.

``encode_documents`` makes such files from a table. Each task writes files under names of its own and
reports them through a table that Spark commits, so files of lost or repeated tasks are never read.

Defined results: a null or empty text is a document of no tokens; every row is a document, repeated
rows included; text that spells the separator is encoded as ordinary text; an empty table gives no
files and no rows; tokens behind the last separator of a file are a document cut short, and counted
as one; other columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gritsieve.llm.arrow import raw, table
from gritsieve.scratch import Scratch

BLOCK_TOKENS = 1 << 20
#: A file is closed when it holds so many tokens.
FILE_TOKENS = 1 << 25
#: Blocks of one stretch of the prefix scan.
STRETCH = 4096


def _rank_tokenizer(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_documents(docs: DataFrame, folder: str, vocabulary: str, pattern: str, separator: int, dtype: str = "<u2", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write flat token files into ``folder``; (file, tokens, ordinal, doc_id) for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, width = _rank_tokenizer(vocabulary, pattern), np.dtype(dtype)
        system, root = pafs.FileSystem.from_uri(folder)
        out = name = None
        tokens, ids = 0, []

        def told() -> pa.RecordBatch:
            return table({"file": ([name] * len(ids), pa.string()), "tokens": ([tokens] * len(ids), pa.int64()), "ordinal": (range(len(ids)), pa.int64()), "doc_id": (ids, pa.int64())})

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw(batch, "text")):
                if out is None:
                    name, tokens, ids = f"{uuid.uuid4().hex}.tokens", 0, []
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                found = encoder.encode_ordinary((text or b"").decode("utf-8", "replace"))
                out.write(np.array([*found, separator], dtype=width).tobytes())
                tokens += len(found) + 1
                ids.append(doc_id)
                if tokens >= file_tokens:
                    out.close()
                    out = None
                    yield told()
        if out is not None:
            out.close()
            yield told()

    system, root = pafs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return slim.mapInArrow(run, "file string, tokens long, ordinal long, doc_id long")


def scan_blocks(files: DataFrame, folder: str, separator: int, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, n_seps, head, tail, inner) of every block of the (file, tokens) rows.

    ``head`` counts the tokens before the first separator, ``tail`` those after the last (all, if
    there is none), ``inner`` lists the lengths of the documents in between.
    """
    blocks = files.where("tokens > 0").select("file", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / block_tokens))).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(dtype)
        system, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                first = row["block"] * block_tokens
                many = min(block_tokens, row["tokens"] - first)
                with system.open_input_file(f"{root}/{row['file']}") as file:
                    ids = np.frombuffer(file.read_at(many * width.itemsize, first * width.itemsize), dtype=width)
                at = np.flatnonzero(ids == separator)
                head, tail = (int(at[0]), len(ids) - int(at[-1]) - 1) if len(at) else (0, len(ids))
                yield table({
                    "file": ([row["file"]], pa.string()), "block": ([row["block"]], pa.int64()), "n_seps": ([len(at)], pa.int64()),
                    "head": ([head], pa.int64()), "tail": ([tail], pa.int64()), "inner": ([np.diff(at) - 1], pa.list_(pa.int64())),
                })

    spread = blocks.repartition("file", "block").select("file", "tokens", "block")
    return spread.mapInArrow(run, "file string, block long, n_seps long, head long, tail long, inner array<long>")


def _before(df: DataFrame, keys: list[str], order: str, value_sum: str, carry: str, resets: str, tag: str) -> DataFrame:
    """Exclusive prefix: the sum of ``value_sum``, and of ``carry`` since (and with) the last row that resets."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    epoch = F.coalesce(F.sum(F.col(resets).cast("long")).over(before), F.lit(0))
    # a row that resets begins a new epoch with its own carry; the rows behind it add theirs
    df = df.withColumn(f"{tag}_n", F.coalesce(F.sum(value_sum).over(before), F.lit(0))).withColumn(f"{tag}_epoch", epoch + F.col(resets).cast("long"))
    inside = Window.partitionBy(*keys, f"{tag}_epoch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    running = df.withColumn(f"{tag}_run", F.sum(carry).over(inside))
    last = Window.partitionBy(*keys).orderBy(order)
    return running.withColumn(f"{tag}_c", F.coalesce(F.lag(f"{tag}_run").over(last), F.lit(0))).drop(f"{tag}_epoch", f"{tag}_run")


def stitch(blocks: DataFrame, scratch: Scratch, stretch: int = STRETCH) -> DataFrame:
    """(file, ordinal, n_tokens) of every document, from block summaries.

    The prefix scan has two levels: within stretches of ``stretch`` blocks, and over one summary for
    each stretch, so even a single file of any size is never scanned by one task.
    """
    small = blocks.select("file", "block", F.floor(F.col("block") / stretch).alias("part"), "n_seps", "head", "tail", (F.col("n_seps") > 0).alias("cut"))
    inner = _before(small, ["file", "part"], "block", "n_seps", "tail", "cut", "in")
    last = F.max(F.struct("block", (F.col("tail") + F.when(F.col("cut"), F.lit(0)).otherwise(F.col("in_c"))).alias("open")))
    parts = inner.groupBy("file", "part").agg(F.sum("n_seps").alias("p_seps"), F.max("cut").alias("p_cut"), last["open"].alias("p_open"))
    outer = _before(parts, ["file"], "part", "p_seps", "p_open", "p_cut", "out").select("file", "part", "out_n", "out_c")
    cut_before = F.col("in_n") > 0
    found = inner.join(outer, ["file", "part"]).select(
        "file", "block", "n_seps", (F.col("in_n") + F.col("out_n")).alias("base"),
        (F.col("in_c") + F.when(cut_before, F.lit(0)).otherwise(F.col("out_c"))).alias("carry"), "head", "tail",
    )
    found = scratch.stash(found, "prefix")
    first = found.where("n_seps > 0").select("file", F.col("base").alias("ordinal"), (F.col("carry") + F.col("head")).alias("n_tokens"))
    inside = blocks.where("n_seps > 1").select("file", "block", F.posexplode("inner").alias("k", "n_tokens")).join(found.select("file", "block", "base"), ["file", "block"])
    inside = inside.select("file", (F.col("base") + F.col("k") + 1).alias("ordinal"), "n_tokens")
    end = found.groupBy("file").agg(F.max(F.struct("block", (F.col("base") + F.col("n_seps")).alias("n"), (F.col("tail") + F.when(F.col("n_seps") > 0, F.lit(0)).otherwise(F.col("carry"))).alias("open"))).alias("e"))
    rest = end.where("e.open > 0").select("file", F.col("e.n").alias("ordinal"), F.col("e.open").alias("n_tokens"))
    return first.unionByName(inside).unionByName(rest)


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, separator: int, block_tokens: int = BLOCK_TOKENS, file_tokens: int = FILE_TOKENS, stretch: int = STRETCH) -> DataFrame:
    """(doc_id, n_tokens) of every document, by way of flat token files in the shared folder."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "token-counts")
    folder = scratch.path("files")
    known = scratch.stash(encode_documents(docs, folder, vocabulary, pattern, separator, file_tokens=file_tokens), "known")
    files = known.where("ordinal = 0").select("file", "tokens")
    blocks = scratch.stash(scan_blocks(files, folder, separator, block_tokens=block_tokens), "blocks")
    scratch.drop("files")
    counts = stitch(blocks, scratch, stretch)
    return known.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
