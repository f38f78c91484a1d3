"""Words of whole UTF-8 texts as numpy arrays, straight from Arrow buffers.

Everything works on the bytes of a slice of rows at once: a byte table marks
which bytes belong to words (bytes of non-ASCII characters always do), a
polynomial prefix hash gives the hash of every word, and a second one over the
word hashes gives the hash of every window of k words. Hashes wrap at 64 bits
and end in a full-avalanche mix. No Python object is made per word.

Rows are cut into slices of about SLICE bytes, so the memory of a task does not
depend on the size of its partition; a longer single text is a slice alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_BYTE_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_WORD_BASE = (0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)
_MASK = (1 << 64) - 1


def _table(inside) -> np.ndarray:
    return np.array([b >= 0x80 or inside(b) for b in range(256)])


#: letters and digits, as benchmark matching and shingles take them
ALNUM = _table(lambda b: chr(b).isalnum())
#: everything but blanks, tabs and line ends
NON_BLANK = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: A-Z to a-z
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on all others."""
    x = np.array(x, dtype=np.uint64, copy=True, ndmin=1)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=64)
def _steps(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers modulo 2^64 of 0 to 1023, and of ``n`` multiples of 1024."""
    def run(factor: int, count: int) -> np.ndarray:
        factors = np.full(count, factor & _MASK, dtype=np.uint64)
        factors[:1] = 1
        return np.cumprod(factors, dtype=np.uint64)
    return run(base, 1024), run(pow(base, 1024, 1 << 64), n)


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of an odd base modulo 2^64, made for each use: kept for every base they would outweigh the texts."""
    low, high = _steps(base, 1 << (n >> 10).bit_length())
    return np.multiply.outer(high[: (n >> 10) + 1], low).ravel()[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def _span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    weighted = powers(base, len(values))
    weighted *= values
    np.cumsum(weighted, dtype=np.uint64, out=total[1:])
    del weighted
    low, high = _steps(inverse(base), 1 << (len(values) >> 10).bit_length())
    return mix((total[end] - total[start]) * low[start & 1023] * high[start >> 10])


@dataclass
class Words:
    """The words of ``n_rows`` texts: byte spans in ``data`` and the row of each."""

    data: np.ndarray
    bounds: np.ndarray  # of the rows in data
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray

    @property
    def n_rows(self) -> int:
        return len(self.bounds) - 1

    def first(self) -> np.ndarray:
        """Index of each row's first word, and the number of words at the end."""
        return np.searchsorted(self.row, np.arange(self.n_rows + 1))

    def counts(self) -> np.ndarray:
        return np.diff(self.first())

    def hashes(self, which: int = 0) -> np.ndarray:
        values = self.data.astype(np.uint64)
        values += np.uint64(1)
        return _span_hashes(values, self.start, self.end, _BYTE_BASE[which])

    def text(self, i: int) -> str:
        return self.data[self.start[i]: self.end[i]].tobytes().decode("utf-8", "replace")


def windows(hashes: np.ndarray, row: np.ndarray, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of k words inside one row."""
    if len(hashes) < k:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    at = np.flatnonzero(row[: len(row) - k + 1] == row[k - 1:])
    return at, _span_hashes(hashes, at, at + k, _WORD_BASE[which])


def row_hashes(hashes: np.ndarray, first: np.ndarray, which: int = 0) -> np.ndarray:
    """One hash for the whole word sequence of each row."""
    return _span_hashes(hashes, first[:-1], first[1:], _WORD_BASE[which])


def split(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts lying one after the other in ``data``."""
    if lower:
        data = LOWER[data]
    member = inside[data]
    before = np.empty_like(member)
    after = np.empty_like(member)
    if len(member):
        before[0], before[1:] = False, member[:-1]
        after[-1], after[:-1] = False, member[1:]
        edges = bounds[(bounds > 0) & (bounds < len(data))]
        before[edges] = False
        after[edges - 1] = False
    start = np.flatnonzero(member & ~before)
    end = np.flatnonzero(member & ~after) + 1
    return Words(data, bounds, start, end, np.searchsorted(bounds, start, side="right") - 1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds of the rows) of a string column; null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[bounds[0]: bounds[-1]], bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, bounds) in slices of about ``limit`` bytes of text."""
    for batch in batches:
        data, bounds = text_bytes(batch.column(batch.schema.get_field_index(column)))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + limit, side="right")) - 1)
            yield batch.slice(low, high - low), data[bounds[low]: bounds[high]], bounds[low: high + 1] - bounds[low]
            low = high
    batch = data = bounds = None
    pa.default_memory_pool().release_unused()  # a worker goes on to other stages


def signed(x: np.ndarray) -> np.ndarray:
    """Hashes as Spark's bigint."""
    return np.ascontiguousarray(x).view(np.int64)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
