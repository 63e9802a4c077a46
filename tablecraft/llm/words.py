"""Words and word windows of whole Arrow batches as numpy arrays of 64-bit hashes.

A word is a maximal run of bytes outside x20 and x09-x0D. Texts are taken in slices of about
``SLICE_BYTES`` (or one text, if it is longer), so memory is bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODES = np.random.Generator(np.random.PCG64(20240117)).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BYTE_BASE, WINDOW_BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers(dict):
    """Powers kept per task; travels empty."""

    def __reduce__(self):
        return _Powers, ()


_KEPT = _Powers()


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, ``size`` of each."""
    up, down = _KEPT.get(base, ((), ()))
    if len(up) < size:
        room = 1 << max(16, (size - 1).bit_length())
        steps = np.array([base, pow(base, -1, 1 << 64)], U64).repeat(room).reshape(2, room)
        steps[:, 0] = 1
        up, down = np.multiply.accumulate(steps, axis=1)
        if room <= 1 << 21:  # beyond that the text is an unusually long one
            _KEPT[base] = up, down
    return up[:size], down[:size]


@dataclass
class Words:
    """Words of some texts, one after another; text ``i`` has the words ``first[i]:first[i + 1]``."""

    rows: slice
    data: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.first) - 1


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def words_of(texts: pa.Array, lower: bool) -> Iterator[Words]:
    """Words of all texts of an Arrow string array; a null text has none."""
    texts = texts.cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return
    _, offs, buf = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset:texts.offset + n + 1]
    raw = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    for at, to in _slices(offsets):
        data = raw[offsets[at]:offsets[to]]
        yield _words(data, offsets[at:to + 1] - offsets[at], slice(at, to), lower)


def _words(data: np.ndarray, offsets: np.ndarray, rows: slice, lower: bool) -> Words:
    size = len(data)
    if size == 0:
        none = np.zeros(0, np.int64)
        return Words(rows, data, np.zeros(0, U64), np.zeros(len(offsets), np.int64), none, none)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < size]
    starts[heads] = inside[heads]
    begin = np.flatnonzero(starts)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    ends[tails] = inside[tails]
    end = np.flatnonzero(ends) + 1
    up, down = powers(_BYTE_BASE, size)
    total = np.zeros(size + 1, U64)
    np.cumsum(_BYTE_CODES[data] * up, out=total[1:])
    hashes = mix((total[end] - total[begin]) * down[begin])
    return Words(rows, data, hashes, np.searchsorted(begin, offsets), begin, end)


def window_hashes(hashes: np.ndarray, width: int, base: int = WINDOW_BASE) -> np.ndarray:
    """A hash for each run of ``width`` words, also for runs that cross from one text to the next."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = powers(base, len(hashes))
    total = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * up, out=total[1:])
    return mix((total[width:] - total[:n]) * down[:n])
