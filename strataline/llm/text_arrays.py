"""Vectorised words, lines and hashes of whole columns of UTF-8 text.

Everything works on the raw bytes of an Arrow string column: the separators of all contracts
(0x20, 0x09-0x0D) and the letters that are folded (A-Z) are single bytes in UTF-8, so byte
positions decide exactly what the equivalent character rules would.

Hashes are 64 bits wide: random byte values times powers of an odd base, summed over the word,
then passed through a finaliser. They are seeded by constants, so every worker and every retry
computes the same values.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; larger only for a single longer text.
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED_VALUES = _BYTE_VALUES.copy()
_FOLDED_VALUES[65:91] = _BYTE_VALUES[97:123]

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    if len(_powers[base]) < n:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])


class Texts:
    """Some consecutive texts of a column: data holds their bytes, offsets where each begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1
        inside = ~IS_SPACE[data]
        begins, lasts = inside.copy(), inside.copy()
        if len(data):
            begins[1:] &= ~inside[:-1]
            lasts[:-1] &= ~inside[1:]
            full = offsets[:-1] < offsets[1:]
            at, to = offsets[:-1][full], offsets[1:][full] - 1
            begins[at] = inside[at]
            lasts[to] = inside[to]
        self.inside = inside
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(lasts) + 1
        #: Words of text i are word_offsets[i] to word_offsets[i + 1].
        self.word_offsets = np.searchsorted(self.starts, offsets)
        self.n_words = np.diff(self.word_offsets)

    def word_texts(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(self.n), self.n_words)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
        """Of the byte ranges given."""
        values = (_FOLDED_VALUES if fold else _BYTE_VALUES)[self.data]
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(_BASE, len(values)), out=sums[1:])
        raw = (sums[ends] - sums[starts]) * powers(_INVERSE, len(values) + 1)[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def words(self, fold: bool = False) -> np.ndarray:
        return self.hashes(self.starts, self.ends, fold)

    def count(self, flags: np.ndarray) -> np.ndarray:
        """Set flags (one for each byte) in each text."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def release() -> None:
    """Gives memory that earlier batches used back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: int, rows: int = 2000, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most rows rows and about limit bytes of a string column, at least one row each.

    What is worked out for a slice is bounded, whatever Arrow's batches hold; memory goes back after each.
    """
    for batch in batches:
        at, n = 0, batch.num_rows
        offsets = utf8(batch.column(column))[1] if n else None
        while at < n:
            to = min(at + rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
            yield batch.slice(at, to - at)
            release()
            at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], at - at[0] if len(at) else np.zeros(1, np.int64)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The column's texts in pieces of about limit bytes, so that temporary arrays stay small."""
    if not len(column):
        return
    data, offsets = utf8(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield Texts(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], row)
        row = end


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; fewer words make one shingle of all."""
    n = len(words)
    if not n:
        return words
    weights = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    if n < k:
        return mix((words * weights[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    total = words[: n - k + 1] * weights[0]
    for i in range(1, k):
        total += words[i : n - k + 1 + i] * weights[i]
    total = np.sort(mix(total))
    return total[np.concatenate(([True], total[1:] != total[:-1]))]
