"""Periodic runs of words, found through string synchronising sets.

A run is a longest possible stretch of consecutive words with smallest period
``q`` (words ``q`` apart are identical) that holds at least ``exponent`` periods
and ``least`` words. All of them are found, in three steps:

1. Periods below SMALL are read off directly: the text is compared with itself
   moved by each of them.
2. For every dyadic scale t from SMALL on, a position is synchronising when the
   smallest hash among the windows of t words starting at it and at the t
   positions behind it belongs to the first or the last of them. Whether it is depends
   on the 2t words from it on only, so equal contexts are chosen alike. Windows of
   a period of at most t/4 are left out; they lie in runs found at earlier scales,
   which keeps the set sparse, and any other 3t words hold a chosen position.
3. Chosen positions that follow each other among those of equal context (2t
   words) at a distance q with t <= q < 2t propose the period q. The stretch
   around them is extended both ways by prefix hashes and then compared word by
   word. Stretches of equal place are one run of the smallest period.

A run of period q with t <= q < 2t has four periods, hence a chosen position in its
first t places, whose context occurs again q words on and not before; so none is
missed. ``exponent`` must therefore be 4 or more.

The documents of a slice are handled together, parted by values that occur once.
Words are what stands between blanks, compared by 64-bit hash. Null and empty texts
have no words and no runs. Repeated rows are judged each by itself; equal ids do
not matter. Extra columns are ignored. A very long text is a slice alone, its
memory is some hundred bytes per word.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm import words as W
from alertloom.llm.batches import bounded

LEAST, EXPONENT = 6, 4
SMALL = 16
_BASE = 0xA24BAED4963EE407


class _Prefix:
    """Hashes of stretches of a sequence."""

    def __init__(self, values: np.ndarray):
        self.down = W.powers(W.inverse(_BASE), len(values) + 1)
        self.total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * W.powers(_BASE, len(values)), dtype=np.uint64, out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.down[start]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """Length of the longest equal stretches from a and b on (``back``: ending there), at most ``most``."""
        known = np.zeros(len(a), dtype=np.int64)
        step = 1 << max(0, int(most.max(initial=0)).bit_length() - 1)
        while step:
            longer = known + step
            ok = np.flatnonzero(longer <= most)
            x, y, n = a[ok], b[ok], longer[ok]
            same = self.of(x - n, x) == self.of(y - n, y) if back else self.of(x, x + n) == self.of(y, y + n)
            known[ok[same]] = n[same]
            step >>= 1
        return known


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` consecutive values."""
    low, done = values, 1
    while done * 2 <= width:
        low = np.minimum(low[: len(low) - done], low[done:])
        done *= 2
    rest = width - done
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def _stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def synchronising(prefix: _Prefix, n: int, t: int, periodic: np.ndarray) -> np.ndarray:
    """Synchronising positions of scale t; ``periodic`` marks the windows left out."""
    if n < 2 * t:
        return np.zeros(0, dtype=np.int64)
    place = np.arange(n - t + 1)
    names = W.mix(prefix.of(place, place + t))
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    names[periodic[: len(names)]] = none
    least = _sliding_least(names, t + 1)
    last = len(least)
    return np.flatnonzero((least != none) & ((least == names[:last]) | (least == names[t: t + last])))


def runs_of(values: np.ndarray, longest: int, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """(start, end, period) of all runs of a sequence, by start, then period; no run is longer than ``longest``."""
    n = len(values)
    found = [np.zeros((0, 3), dtype=np.int64)]
    for q in range(1, min(SMALL - 1, longest // exponent) + 1):
        start, end = _stretches(values[:-q] == values[q:])
        keep = end + q - start >= max(least, exponent * q)
        found.append(np.stack([start[keep], end[keep] + q, np.full(keep.sum(), q)], axis=1))
    prefix, t = None, SMALL
    while exponent * t <= longest:
        prefix = prefix or _Prefix(values)
        known = np.concatenate(found)
        known = known[(known[:, 2] * 4 <= t) & (known[:, 1] - known[:, 0] >= t)]
        inside = np.zeros(n + 1, dtype=np.int32)
        np.add.at(inside, known[:, 0], 1)
        np.add.at(inside, known[:, 1] - t + 1, -1)
        chosen = synchronising(prefix, n, t, np.cumsum(inside[:-1]) > 0)
        context = prefix.of(chosen, chosen + 2 * t)
        order = np.argsort(context, kind="stable")  # of equal contexts by place
        a, b = chosen[order[:-1]], chosen[order[1:]]
        pair = (context[order[:-1]] == context[order[1:]]) & (b - a >= t) & (b - a < 2 * t)
        a, b = a[pair], b[pair]
        q = b - a
        start = a - prefix.common(a, b, a, back=True)
        end = b + prefix.common(a, b, n - b)
        keep = end - start >= np.maximum(least, exponent * q)
        some = np.unique(np.stack([start[keep], end[keep], q[keep]], axis=1), axis=0)
        found.append(some[_verified(values, some)])
        t *= 2
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), dtype=bool)  # a multiple of the period has the same place
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _verified(values: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Runs whose words are equal one by one and differ at both ends."""
    start, end, q = runs.T
    size = end - q - start
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)
    equal = values[at] == values[at + np.repeat(q, size)]
    wrong = np.bincount(np.repeat(np.arange(len(runs)), size), weights=~equal, minlength=len(runs)) > 0
    n = len(values)
    before = (start > 0) & (values[np.maximum(start - 1, 0)] == values[np.maximum(start - 1, 0) + q])
    after = (end < n) & (values[np.minimum(end, n - 1)] == values[np.minimum(end, n - 1) - q])
    return ~(wrong | before | after)


def joined(words: W.Words, index: np.ndarray) -> pa.Array:
    """A text per row: its words of the given numbers, in their order, with one blank between."""
    row = words.row[index]
    size = words.end[index] - words.start[index]
    last = np.append(row[1:] != row[:-1], True)[: len(row)]
    ends = np.cumsum(size + ~last)
    offsets = np.concatenate(([0], ends))[np.searchsorted(row, np.arange(words.n_rows + 1))].astype(np.int64)
    out = np.full(offsets[-1], 0x20, dtype=np.uint8)
    done = np.cumsum(size)
    at = np.arange(done[-1] if len(done) else 0)
    out[at + np.repeat(ends - (size + ~last) - done + size, size)] = words.data[at + np.repeat(words.start[index] - done + size, size)]
    return pa.LargeStringArray.from_buffers(words.n_rows, pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _find_rows(least: int, exponent: int):
    def run(batches):
        for rows, data, bounds in W.slices(batches):
            words = W.split(data, bounds, W.NON_BLANK)
            first = words.first()
            place = np.arange(len(words.row)) + words.row  # a value that occurs once follows each row
            values = W.mix(np.arange(len(words.row) + words.n_rows, dtype=np.uint64) + np.uint64(1 << 62))
            values[place] = words.hashes()
            runs = runs_of(values, int(np.diff(first).max(initial=0)), least, exponent)
            row = np.searchsorted(first[1:] + np.arange(words.n_rows), runs[:, 0])
            start, length, period = runs[:, 0] - first[row] - row, runs[:, 1] - runs[:, 0], runs[:, 2]
            gone = np.zeros(len(words.row) + 1, dtype=np.int32)
            np.add.at(gone, runs[:, 0] - row + period, 1)
            np.add.at(gone, runs[:, 1] - row, -1)
            kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
            ends = np.searchsorted(row, np.arange(words.n_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
                [pa.array(x.astype(np.int64)) for x in (start, length, period)], fields=list(_RUN)))
            yield pa.RecordBatch.from_arrays([W.column(rows, "doc_id"), pa.array(np.diff(first).astype(np.int64)), lists, joined(words, kept)],
                                             names=["doc_id", "n_words", "runs", "collapsed"])
    return run


def find(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: all runs by start, then period, and the text without what repeats a run's first period."""
    if exponent < 4:
        raise ValueError("runs of fewer than 4 periods are not all found by these scales")
    rows = bounded(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_find_rows(least, exponent), f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def _looped_rows(batches):
    for rows, data, bounds in W.slices(batches):
        words = W.split(data, bounds, W.NON_BLANK)
        first, index = words.first(), np.arange(len(words.row))
        for r, doc in enumerate(W.column(rows, "doc_id").to_pylist()):
            n, h = int(first[r + 1] - first[r]), zlib.crc32(str(doc).encode()) if doc is not None else 1
            if n and h % 10 == 0:
                g = h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                index[first[r] + a: first[r + 1]] = first[r] + a + np.arange(n - a) % p
        yield pa.RecordBatch.from_arrays([W.column(rows, "doc_id"), joined(words, index)], names=["doc_id", "text"])


def looped(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: words joined by one blank, in a tenth of the documents (by crc32 of the id) with a tail that repeats."""
    rows = bounded(docs).select("doc_id", "text")
    return rows.mapInArrow(_looped_rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digest(found: DataFrame) -> DataFrame:
    """The result of ``find`` as the longest run, and hashes of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.floor(F.expr("1000 * best.length div -best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
