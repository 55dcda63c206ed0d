"""Quality rules: compression bands, beside plain counting rules.

``quality_report`` measures every document; ``quality_filter`` keeps the documents that pass. Both
are one pass over the rows without a shuffle, so a lost executor repeats its own tasks only.

Defined results: a null text counts as an empty one (no words, so the counting rules reject it); a
null ``doc_id`` stays null; repeated rows are judged alike, each on its own; an empty table gives an
empty result; other columns are ignored by the report and returned unchanged by the filter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from gritsieve.llm.arrow import raw, table


@dataclass(frozen=True)
class Band:
    """Limits on raw / compressed bytes for texts of at least ``size`` bytes."""

    size: int
    low: float
    high: float


#: Limits by length: short texts compress little, so their limits are wide. Prose of the test tables
#: lies a fifth or more inside of them at every length.
BANDS = (
    Band(0, 0.0, 2.2),
    Band(256, 1.0, 2.6),
    Band(512, 1.2, 2.8),
    Band(1024, 1.35, 3.0),
    Band(2048, 1.5, 3.1),
    Band(4096, 1.55, 3.3),
    Band(16384, 1.6, 3.6),
    Band(65536, 1.6, 4.2),
)


@dataclass(frozen=True)
class QualityRules:
    """All limits. ``chunk_share``: the share of a text's chunks outside their band that rejects it."""

    min_words: int = 50
    max_repeat_percent: int = 50
    bands: tuple[Band, ...] = BANDS
    chunk_bytes: int = 4096
    chunk_share: float = 0.25
    level: int = 3

    def band(self, size: int) -> Band:
        return max((b for b in self.bands if b.size <= size), key=lambda b: b.size)


#: Characters that count as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"


class Measure(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool
    ratio: float
    chunks_out: int


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a three-word window that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    hit = np.zeros(len(words), dtype=bool)
    twice = np.fromiter((counts[w] > 1 for w in windows), dtype=bool, count=len(windows))
    for shift in range(3):
        hit[shift : shift + len(windows)] |= twice
    return int(hit.sum())


class Judge:
    """Measures texts; holds one compressor, so one belongs to one task."""

    def __init__(self, rules: QualityRules) -> None:
        self.rules, self._zstd = rules, zstandard.ZstdCompressor(level=rules.level, write_content_size=False, write_checksum=False)

    def ratio(self, data: bytes) -> float:
        return len(data) / len(self._zstd.compress(data)) if data else 1.0

    def _outside(self, data: bytes, ratio: float) -> bool:
        band = self.rules.band(len(data))
        return not band.low <= ratio <= band.high

    def measure(self, text: bytes | None) -> Measure:
        data, rules = text or b"", self.rules
        words = data.split()
        histogram = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
        points = len(data) - int(histogram[0x80:0xC0].sum())
        lines = [line for line in data.split(b"\n") if line.strip()]
        repeats = repeated_words(words)
        failed = len(words) < rules.min_words or 100 * repeats > rules.max_repeat_percent * len(words)
        ratio = self.ratio(data)
        chunks = [data[at : at + rules.chunk_bytes] for at in range(0, len(data), rules.chunk_bytes)] if len(data) > rules.chunk_bytes else []
        outside = sum(self._outside(chunk, self.ratio(chunk)) for chunk in chunks)
        good = not self._outside(data, ratio) and outside <= rules.chunk_share * len(chunks)
        return Measure(
            len(words), points - sum(int(histogram[c]) for c in WHITE), sum(int(histogram[c]) for c in SYMBOLS), len(lines) - len(set(lines)),
            repeats, failed, good and not failed, ratio, outside,
        )


REPORT_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunks_out long"


def quality_report(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row of measures and verdicts for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(rules)
        for batch in batches:
            found = list(zip(*map(judge.measure, raw(batch, "text")))) or [()] * len(Measure._fields)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int64()]
            yield table({"doc_id": (batch.column("doc_id"), pa.int64())} | {name: (found[k], kinds[k]) for k, name in enumerate(Measure._fields)})

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, REPORT_SCHEMA)


def quality_filter(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that pass, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(rules)
        for batch in batches:
            yield batch.filter(pa.array([judge.measure(text).kept for text in raw(batch, "text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
