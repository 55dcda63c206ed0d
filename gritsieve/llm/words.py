"""Words of texts of any length as arrays of hashes, a piece of text at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Bytes of a text whose words are held as objects at once, and the most words a memo remembers.
PIECE = 1 << 20
MEMO = 1 << 18


def pieces(data: bytes, size: int = PIECE, space: bytes = b" \t\n\x0b\x0c\r") -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes that are cut at white space, so that no word is cut."""
    at = 0
    while len(data) - at > size:
        stop = at + size
        end = max(data.rfind(bytes([c]), at, stop) for c in space)
        if end <= at:  # one word beyond the size: cut after it
            later = [p for c in space if (p := data.find(bytes([c]), stop)) >= 0]
            end = min(later, default=len(data))
        yield data[at:end]
        at = end
    yield data[at:]


class Memo(dict):
    """``of(word)`` for each distinct word once, up to ``MEMO`` words at a time."""

    def __init__(self, of: Callable[[bytes], int]) -> None:
        self.of = of

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = self.of(word)
        return value

    def array(self, data: bytes, dtype: type = np.uint64) -> np.ndarray:
        """The values of all words of a text, in order."""
        found = [np.fromiter(map(self.__getitem__, words), dtype=dtype, count=len(words)) for words in (p.split() for p in pieces(data))]
        return found[0] if len(found) == 1 else np.concatenate(found)
