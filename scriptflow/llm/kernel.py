"""Vectorised text primitives shared by the corpus operators.

Words are maximal runs of bytes other than space and 0x09-0x0D, found on the UTF-8 bytes of
whole texts. All functions work on a slice of an Arrow batch, cut by bytes, so that memory is
bounded by SLICE_BYTES or by the longest single text, whichever is larger.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at once; arrays of eight bytes for each of them stand beside them.
SLICE_BYTES = 1 << 18

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BYTE_BASE = np.uint64(0xD6E8FEB86659FD93)
_WORD_BASE = np.uint64(0xA0761D6478BD642F)
_SECOND_BASE = np.uint64(0xE7037ED1A0B428DB)
_SECOND_BYTE_BASE = np.uint64(0x8EBC6AF09C88C6E3)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (three xor-shifts, two multiplications)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUES_LOWER = _VALUES[_LOWER]


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, extended on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS, _SECOND, _SECOND_BYTES = _Powers(_BYTE_BASE), _Powers(_WORD_BASE), _Powers(_SECOND_BASE), _Powers(_SECOND_BYTE_BASE)


@dataclass
class Words:
    """Words of a run of texts: byte bounds, and for text i the words first[i]:first[i+1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = False, second: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; with lower, A-Z count as a-z; second: another hash, on another base."""
        n = len(self.data)
        if not len(self.starts):
            return np.empty(0, np.uint64)
        up, down = (_SECOND_BYTES if second else _BYTES).get(n + 1)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum((_VALUES_LOWER if lower else _VALUES)[self.data] * up[:n], out=sums[1:])
        out = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        return mix(out + (self.ends - self.starts).astype(np.uint64) * _GOLDEN)


def slices(texts: pa.Array | pa.ChunkedArray, budget: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (from row, to row, bytes, offsets) with about budget bytes each; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + budget, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def release() -> None:
    """Gives free memory back to the system, which a Python worker would keep through all its later tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc only
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; what it and the tasks before it have freed is given back before and after it."""

    @functools.wraps(run)
    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from run(batches)
        release()

    return released


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Finds the words of texts that lie side by side in data."""
    n = len(data)
    inner = np.zeros(n + 2, bool)
    inner[1:-1] = ~_SEPARATOR[data]
    start, end = inner[1:-1] & ~inner[:-2], inner[1:-1] & ~inner[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    start[cuts] |= inner[1:-1][cuts]
    end[cuts - 1] |= inner[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def window_hashes(h: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """A hash of each k consecutive entries of h, text bounds ignored; an empty array if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = (_SECOND if second else _WORDS).get(len(h) + 1)
    sums = np.empty(len(h) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * down[:n] + np.uint64(k * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF))


def windows_inside(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n windows of k words lie within one text."""
    last = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + k <= last


def sliding(x: np.ndarray, width: int, op=np.minimum) -> np.ndarray:
    """op over each width consecutive entries, by doubling."""
    out, have = x, 1
    while have * 2 <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return op(out[:-rest], out[rest:]) if rest else out
