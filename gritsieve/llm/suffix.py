"""Array steps of the difference-cover suffix sort; each works on one block or one range of names.

A place is *sampled* when the last digits of its offset in base 3 are all 1 or 2: two places in three,
of these two in three again, and so on. Any two offsets have a common shift below ``stride`` that
makes both sampled, which is what a difference cover is for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard

LEAST_LENGTH = 30
#: Fewer bytes than these would name hardly anything.
LEAST_WIDTH = 16
U = np.uint64


@dataclass(frozen=True)
class Plan:
    """How strings of ``length`` bytes are compared.

    Samples are named by ``width`` bytes first. Each of the ``recursions`` names triples of names that
    stand ``stride`` apart, until the names stand for ``depth`` bytes. Strings are told apart by the
    name of a sample and the ``stride - 1`` bytes around it.
    """

    length: int
    stride: int
    width: int
    recursions: int

    @property
    def depth(self) -> int:
        return self.length - self.stride + 1

    @property
    def around(self) -> int:
        return self.stride - 1


def plan(length: int) -> Plan:
    if length < LEAST_LENGTH:
        raise ValueError(f"the length must be at least {LEAST_LENGTH}")
    stride = 9
    while 9 * stride <= length:
        stride *= 3
    depth = length - stride + 1
    recursions = (depth - LEAST_WIDTH) // (2 * stride)
    return Plan(length, stride, depth - 2 * stride * recursions, recursions)


def cover(stride: int) -> np.ndarray:
    """Which residues modulo ``stride`` are sampled."""
    digits, sampled = np.arange(stride), np.ones(stride, dtype=bool)
    while stride > 1:
        sampled &= digits % 3 != 0
        digits, stride = digits // 3, stride // 3
    return sampled


# --- packing -----------------------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """An array of numbers, byte planes apart, so that what is constant costs nothing."""
    planes = np.ascontiguousarray(values.reshape(len(values), -1).view(np.uint8).T)
    return zstandard.ZstdCompressor(level=1, write_checksum=False).compress(planes.tobytes())


def unpack(data: bytes, dtype: str, columns: int = 1) -> np.ndarray:
    kind = np.dtype(dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(columns * kind.itemsize, -1)
    values = np.ascontiguousarray(planes.T).view(kind)
    return values.reshape(-1) if columns == 1 else values.reshape(-1, columns)


def pack_places(places: np.ndarray) -> bytes:
    """Ascending places as differences."""
    return pack(np.diff(places, prepend=0).astype("<i4"))


def unpack_places(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<i4"), dtype=np.int64)


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1, write_checksum=False).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


# --- blocks ------------------------------------------------------------------------------------


class Block:
    """Pieces of texts, one after the other; ``base`` is a piece's offset in its text, ``size`` its bytes."""

    def __init__(self, number: int, data: bytes, base: list[int], size: list[int], plan: Plan) -> None:
        self.number, self.plan = number, plan
        self.base, self.size = np.array(base, dtype=np.int64), np.array(size, dtype=np.int64)
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self.n = int(self.end[-1]) if len(self.end) else 0
        before, after = plan.around, plan.length + 8
        self.padded = np.concatenate([np.zeros(before, dtype=np.uint8), np.frombuffer(data, dtype=np.uint8), np.zeros(after, dtype=np.uint8)])
        self.data = self.padded[before:]

    def sampled(self, width: int) -> np.ndarray:
        """The sampled places with ``width`` bytes of their piece ahead."""
        stride, offsets = self.plan.stride, np.flatnonzero(cover(self.plan.stride)).astype(np.int32)
        begin = (self.start - self.base % stride).astype(np.int32)  # where the stride of each piece's first byte begins
        strides = -(-(self.end - begin) // stride)
        piece = np.repeat(np.arange(len(begin), dtype=np.int32), strides)
        nth = np.arange(len(piece), dtype=np.int32) - np.repeat((np.cumsum(strides) - strides).astype(np.int32), strides)
        places = (begin[piece] + nth * np.int32(stride))[:, None] + offsets
        fits = (places >= self.start[piece].astype(np.int32)[:, None]) & (places <= (self.end - width)[piece].astype(np.int32)[:, None])
        return places[fits].astype(np.int64)

    def room(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the piece before each place, and from it on."""
        piece = np.searchsorted(self.end, places, side="right")
        return places - self.start[piece], self.end[piece] - places

    def bytes_at(self, places: np.ndarray, width: int) -> np.ndarray:
        """A row of ``width`` bytes for each place; places may lie up to ``around`` before the data."""
        return np.lib.stride_tricks.sliding_window_view(self.padded, width)[places + self.plan.around] if width else np.empty((len(places), 0), dtype=np.uint8)

    def prefixes(self, places: np.ndarray) -> np.ndarray:
        """The first eight bytes at each place, as a number of the same order."""
        return np.ndarray(len(self.data) - 7, dtype=">u8", buffer=self.data, strides=(1,))[places].astype(U)

    def thinned(self, places: np.ndarray) -> bytes:
        """The data with zeros wherever no string around the places reaches."""
        edge = np.zeros(self.n + 1, dtype=np.int32)
        np.add.at(edge, np.maximum(places - self.plan.around, 0), 1)
        np.add.at(edge, np.minimum(places + self.plan.length, self.n), -1)
        return np.where(np.cumsum(edge[:-1]) > 0, self.data[: self.n], 0).astype(np.uint8).tobytes()


def big_endian(names: np.ndarray) -> np.ndarray:
    return names.astype(">u8").view(np.uint8).reshape(-1, 8)


def triples(block: Block, names: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """Keys of triples of names: those at a place, one and two strides on, and the bytes that they leave out.

    ``names`` has the name of every place of the block or zero; ``places`` have all three.
    """
    s, gap = block.plan.stride, max(0, block.plan.stride - width)
    parts = []
    for step in range(3):
        parts.append(big_endian(names[places + step * s]))
        if gap and step < 2:
            parts.append(block.bytes_at(places + step * s + width, gap))
    return np.concatenate(parts, axis=1)


def triple_places(block: Block, names: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """The named places that have names one and two strides on, in the same piece."""
    s = block.plan.stride
    there = places[block.room(places)[1] >= width + 2 * s]
    return there[(names[there + s] != 0) & (names[there + 2 * s] != 0)]


def triple_width(plan: Plan, width: int) -> int:
    return 24 + 2 * max(0, plan.stride - width)


# --- sorting and naming ------------------------------------------------------------------------


def words_of(keys: np.ndarray) -> np.ndarray:
    """Keys of equal width as rows of numbers that sort alike."""
    m, w = keys.shape
    wide = np.zeros((m, -(-w // 8) * 8), dtype=np.uint8)
    wide[:, :w] = keys
    return wide.view(">u8").astype(U)


def key_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of rows, and whether each row of that order differs from the one before.

    Rows are sorted by the first word, then half a word at a time where they are tied so far.
    """
    n = len(words)
    order, new = np.argsort(words[:, 0]) if n else np.empty(0, dtype=np.int64), np.ones(n, dtype=bool)
    tied, run = _ties(words[order, 0], np.arange(n))
    for k in range(1, words.shape[1]):
        for shift in (U(32), U(0)):
            if not len(tied):
                return order, new
            rows = order[tied]
            keys = (run.astype(U) << U(32)) | ((words[rows, k] >> shift) & U(0xFFFFFFFF))
            by = np.argsort(keys)
            order[tied] = rows[by]
            tied, run = _ties(keys[by], tied)
    order[tied] = np.sort((run.astype(U) << U(32)) | order[tied].astype(U)) & U(0xFFFFFFFF)  # equal rows stay in their order
    new[tied[1:][run[1:] == run[:-1]]] = False
    return order, new


def _ties(ranked: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted values that stand at places ``at``: the places of those that occur twice or more, and the number of their run."""
    same = ranked[1:] == ranked[:-1]
    tied = np.concatenate([same, np.zeros(min(1, len(ranked)), dtype=bool)]) | np.concatenate([np.zeros(min(1, len(ranked)), dtype=bool), same])
    head = np.concatenate([np.ones(min(1, len(ranked)), dtype=bool), ~same])
    return at[tied], np.cumsum(head[tied])


def distinct(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, how often each occurs, its first place; and (first, later) places of the repeats.

    ``places`` ascend.
    """
    order, new = key_order(words_of(keys))
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(order)))
    first = places[order[head]]
    again = np.stack([np.repeat(first, count)[~new], places[order][~new]])
    return keys[order[head]], count, first, again


def cut_points(keys: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """Where each range between the ``splits`` starts among sorted keys of the same width."""
    return np.searchsorted(np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").reshape(-1), splits)


# --- merging -----------------------------------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(29))


def repeats_among(names: np.ndarray, left: np.ndarray, right: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which strings around samples start earlier: a row for each sample, a column for each shift k.

    The string of shift k is made of the last k bytes of ``left``, the sample, and the first
    ``around - k`` bytes of ``right``; it exists if its piece has the bytes (``before``, ``after``).
    Rows are in the order of the corpus. Hashes bring equal strings together, adjacent ones are compared.
    """
    m, around = left.shape
    shifts = np.arange(around + 1)
    exists = (shifts <= before[:, None]) & (around - shifts <= after[:, None])
    again = np.zeros((m, around + 1), dtype=bool)
    if not m:
        return again
    # samples with the same bytes all around are one: those after the first repeat as a whole
    room = np.minimum(np.stack([before, after], axis=1), around).astype("<u2").view(np.uint8).reshape(m, 4)
    whole = np.concatenate([left, right, room], axis=1)
    wide = words_of(whole)
    h = mixed(names.astype(U))
    for k in range(wide.shape[1]):
        h = mixed(h * U(0x9E3779B97F4A7C15) + wide[:, k])
    order, new = key_order(h[:, None])
    same = ~new
    same[1:] &= (names[order[1:]] == names[order[:-1]]) & (wide[order[1:]] == wide[order[:-1]]).all(axis=1)
    again[order[same]] = exists[order[same]]
    # the others are compared shift by shift, if their name has several
    rows = np.sort(order[~same])
    kinds, which, count = np.unique(names[rows], return_inverse=True, return_counts=True)
    rows = rows[count[which] > 1]
    if not len(rows):
        return again
    name, left, right, exists = names[rows], left[rows], right[rows], exists[rows]
    odd = mixed(np.arange(1, 2 * around + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
    base = mixed(name.astype(U))
    both = words_of(np.concatenate([left, right], axis=1))
    on_left, on_right = np.zeros(len(rows), dtype=U), np.zeros(len(rows), dtype=U)
    for j in range(around):
        on_right += (right[:, j].astype(U) + U(1)) * odd[j]
    for k in range(around + 1):
        if k:
            on_left += (left[:, around - k].astype(U) + U(1)) * odd[around + k - 1]
            on_right -= (right[:, around - k].astype(U) + U(1)) * odd[around - k]
        here = np.flatnonzero(exists[:, k])
        order, new = key_order(mixed(base[here] ^ mixed(on_left[here] + on_right[here]))[:, None])
        same = ~new
        order = here[order]
        one, two = order[:-1][same[1:]], order[1:][same[1:]]
        string = np.zeros((1, 2 * around), dtype=np.uint8)
        string[0, around - k : 2 * around - k] = 255
        equal = (name[one] == name[two]) & ~((both[one] ^ both[two]) & words_of(string)).any(axis=1)
        if not equal.all():  # different strings under one hash: sort the strings themselves
            run = np.isin(order, np.concatenate([one, two]))
            order = np.sort(order[run])
            words = words_of(np.concatenate([big_endian(name[order]), left[order, around - k :], right[order, : around - k]], axis=1))
            by_key, new = key_order(words)
            two, equal = order[by_key[~new]], slice(None)
        again[rows[two[equal]], k] = True
    return again
