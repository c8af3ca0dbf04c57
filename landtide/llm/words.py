"""Words of Arrow text columns as NumPy arrays.

A word is a run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; this is also what
``bytes.split()`` gives. Everything here works on slices of whole texts, so that
the arrays of a task stay within a few dozen megabytes whatever a batch holds;
a text longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C17)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class Words(NamedTuple):
    """``starts``/``ends``: byte bounds of each word in ``buf``; ``offs``: word bounds of each text; ``texts``: byte bounds of each text."""

    buf: np.ndarray
    texts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offs: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``lo:hi`` with the UTF-8 bytes of their texts and the texts' bounds; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return _LOWER[buf]


def words(buf: np.ndarray, texts: np.ndarray) -> Words:
    inside = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[texts] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return Words(buf, texts, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, texts))


def hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in random byte values, scrambled."""
    if not len(w.starts):
        return np.zeros(0, np.uint64)
    lens = w.ends - w.starts
    first = np.cumsum(lens) - lens
    longest = int(lens.max())
    powers = np.full(longest, _BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    within = np.arange(int(lens.sum())) - np.repeat(first, lens)
    values = _BYTE[w.buf[np.repeat(w.starts, lens) + within]] * powers[within]
    return mix(np.add.reduceat(values, first) + lens.astype(np.uint64) * _MIX)


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between successive ``bounds``."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def sized_batches(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text in ``column``; a longer text is a batch of its own."""
    for b in batches:
        for lo, hi, _, _ in slices(b.column(column), limit):
            yield b.slice(lo, hi - lo)


def string_batches(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)
