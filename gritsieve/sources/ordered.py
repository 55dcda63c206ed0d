"""Ordered text files, read by splits and written by many tasks.

Reading: a file that can be split is read by as many tasks as it has splits. A row knows the start of its
split and its own place in it; line numbers follow from a prefix sum over one count for each split. A gzip
file is one split, read line by line.

Writing: rows are formatted and sorted by ranges where they are, each range becomes a numbered part in the
shared folder, and the parts are joined in their order, a block of bytes at a time. So neither side holds a file
or a run in memory.
"""

from __future__ import annotations

import gzip
import os
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import IO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gritsieve.scratch import Scratch

#: Bytes of a part that the driver holds at once.
BLOCK = 4 << 20


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, pos, line) of every line of one or more files; ``pos`` is 0 for the first line of its file.

    Lines end at ``\\n``; blank ones count. The numbers are the same at any size of the splits.
    """
    rows = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"),
    )
    splits = rows.groupBy("path", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    ahead = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each split; written, so that the planner knows its size and both reads see the same splits
    starts = Scratch(spark, "splits").stash(splits.select("path", "split", (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first")).alias("shift")), "starts")
    return rows.join(starts, ["path", "split"]).select("path", (F.col("at") + F.col("shift")).alias("pos"), "line")


def formatted(rows: DataFrame, order: Sequence[str], line: Callable[[dict], str]) -> DataFrame:
    """(*order, line): each row as a line of text, made where the row is."""
    fields = [f for f in rows.schema.fields if f.name in order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = pa.array([line(row) for row in batch.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], lines], [*[f.name for f in fields], "line"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", line string")


@dataclass(frozen=True)
class Sorted:
    """Lines of a DataFrame (*order, line) in their order, with a separator between them."""

    rows: DataFrame
    order: tuple[str | Column, ...]
    between: str = "\n"
    tasks: int | None = None


def _parts(piece: Sorted, scratch: Scratch, name: str) -> Iterator[bytes]:
    """The bytes of the sorted lines, each ended by a line feed, in blocks."""
    spark = piece.rows.sparkSession
    dealt = piece.rows.repartitionByRange(piece.tasks or spark.sparkContext.defaultParallelism, *piece.order).sortWithinPartitions(*piece.order)
    dealt.select("line").write.text(scratch.path(name), lineSep="\n")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch.path(name))
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for path in sorted((f.getPath() for f in files.listStatus(folder)), key=lambda p: p.getName()):
        if path.getName().startswith("part-"):
            stream = files.open(path)
            try:
                while block := bytes(stream.readNBytes(BLOCK)):
                    yield block
            finally:
                stream.close()
    scratch.drop(name)


def _written(out: IO[bytes], pieces: Iterable[str | Sorted], scratch: Scratch) -> None:
    for number, piece in enumerate(pieces):
        if isinstance(piece, str):
            out.write(piece.encode())
            continue
        between, held = piece.between.encode(), b""
        for block in _parts(piece, scratch, f"parts-{number}"):
            data = held + (block if between == b"\n" else block.replace(b"\n", between))
            cut = len(data) - len(between)  # what stands last may be the end, which gets no separator
            out.write(data[:cut])
            held = data[cut:]


def write_pieces(spark: SparkSession, path: str, pieces: Iterable[str | Sorted]) -> None:
    """Write texts and sorted lines one after the other, gzip if the name says so: under a temporary name, then renamed.

    The same pieces give the same bytes, whatever the number of tasks.
    """
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.part", "wb") as raw:
        if path.endswith(".gz"):
            with gzip.GzipFile(filename="", mode="wb", fileobj=raw, mtime=0) as packed:
                _written(packed, pieces, Scratch(spark, "ordered"))
        else:
            _written(raw, pieces, Scratch(spark, "ordered"))
    os.replace(f"{path}.part", path)
