"""Helpers for operators that run over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa

MASK64 = (1 << 64) - 1


def spare(taken: Sequence[str], *names: str) -> list[str]:
    """Names for helper columns that none of the ``taken`` columns has, whatever the case."""
    held, mark = {t.lower() for t in taken}, "__"
    while any(mark + n in held for n in names):
        mark += "_"
    return [mark + n for n in names]


def raw(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A text column as UTF-8 bytes, without decoding it."""
    column = batch.column(name)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def signed(value: int) -> int:
    """An unsigned 64-bit integer as Spark's bigint."""
    return value - (1 << 64) if value >> 63 else value


def table(columns: dict[str, tuple[Sequence, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in columns.values()], list(columns))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of ``column``, one row at least."""
    for batch in batches:
        if batch.num_rows <= 1 or batch.column(column).nbytes <= most:
            yield batch
            continue
        start, held = 0, 0
        for row in range(batch.num_rows):
            size = len(batch.column(column)[row].as_buffer() or b"") if batch.column(column)[row].is_valid else 0
            if held and held + size > most:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        yield batch.slice(start)
