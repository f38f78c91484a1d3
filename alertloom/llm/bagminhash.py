"""Weighted MinHash of word multisets by hierarchical Poisson processes.

An element of weight w covers the discretised weight axis up to w. The axis is
cut into dyadic nodes [0,1), [1,2), [2,4), [4,8), ... Each (element, node) owns a
Poisson process whose rate is the node's length; a point carries a time, a
signature position and a place inside the node, all from a hash keyed by the
element, the node and the number of the point. A node that lies below w as a
whole gives all its points; the topmost one only those whose place is below w,
which is the same as descending into its halves. A signature component is the
earliest time at its position, so two bags agree there with a probability equal
to their weighted Jaccard similarity.

Points are made only up to a horizon at which all positions are filled with
high probability; bags with an empty position get twice the horizon and so on,
which keeps the signature exact.
"""

from __future__ import annotations

import numpy as np

from alertloom.llm import words as W

MASK64 = (1 << 64) - 1


def _uniform(bits: np.ndarray) -> np.ndarray:
    """(0, 1] from the upper 53 bits."""
    return ((bits >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0 ** -53


def _times(row, key, node, weight, horizon, n_rows: int, m: int) -> np.ndarray:
    """Earliest time by (row, position); infinite where there is none."""
    best = np.full(n_rows * m, np.inf)
    rate = np.where(node == 0, 1.0, 2.0 ** (node - 1.0))
    low = np.where(node == 0, 0.0, 2.0 ** (node - 1.0))
    state = W.mix(key + node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    time = np.zeros(len(row))
    limit = horizon[row]
    while len(row):
        state = W.mix(state + np.uint64(0xA0761D6478BD642F))
        time = time - np.log(_uniform(state)) / rate
        live = time < limit
        if not live.all():
            row, state, time, limit, rate, low, weight = (x[live] for x in (row, state, time, limit, rate, low, weight))
        spot = W.mix(state ^ np.uint64(0xE7037ED1A0B428DB))
        position = ((spot & np.uint64(0xFFFFFFFF)) * np.uint64(m)) >> np.uint64(32)
        place = low + np.floor((spot >> np.uint64(32)).astype(np.float64) * 2.0 ** -32 * rate)
        inside = place < weight
        np.minimum.at(best, row[inside] * m + position[inside].astype(np.int64), time[inside])
    return best.reshape(n_rows, m)


def signatures(row: np.ndarray, key: np.ndarray, weight: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """Signatures (n_rows x m, uint32) of bags given as (row, element, weight) with each pair once.

    Rows without elements get a signature of zeros.
    """
    signature = np.zeros((n_rows, m), dtype=np.uint32)
    total = np.bincount(row, weights=weight, minlength=n_rows)
    top = np.ceil(np.log2(weight)).astype(np.int64)  # the last node that starts below the weight
    pair = np.repeat(np.arange(len(row)), top + 1)
    node = np.arange(len(pair)) - np.repeat(np.cumsum(top + 1) - top - 1, top + 1)
    p_row, p_key, p_weight = row[pair], key[pair], weight[pair].astype(np.float64)
    horizon = np.where(total > 0, m * (np.log(m) + 4.0) / np.maximum(total, 1.0), 0.0)
    open_rows = total > 0
    while open_rows.any():
        if open_rows.all():
            pick = slice(None)
            ids = np.arange(n_rows)
        else:
            pick = open_rows[p_row]
            ids = np.flatnonzero(open_rows)
        local = np.zeros(n_rows, dtype=np.int64)
        local[ids] = np.arange(len(ids))
        best = _times(local[p_row[pick]], p_key[pick], node[pick], p_weight[pick], horizon[ids], len(ids), m)
        full = np.isfinite(best).all(axis=1)
        signature[ids[full]] = (W.mix(best[full].view(np.uint64).ravel()) >> np.uint64(32)).astype(np.uint32).reshape(-1, m)
        open_rows = np.zeros(n_rows, dtype=bool)
        open_rows[ids[~full]] = True
        horizon = horizon * 2.0
    return signature


def bags(words: W.Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count) of the k-word shingles; a text of fewer words is one shingle."""
    at, key = W.windows(hashes, words.row, k)
    row = words.row[at]
    first = words.first()
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < k))
    if len(short):
        row = np.concatenate([row, short])
        key = np.concatenate([key, W.row_hashes(hashes, first)[short]])
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    return row[at], key[at], np.diff(np.append(at, len(row)))


def weighted_jaccard(key_a, count_a, key_b, count_b) -> float:
    """Of two bags with sorted keys."""
    total = int(count_a.sum() + count_b.sum())
    _, ia, ib = np.intersect1d(key_a, key_b, assume_unique=True, return_indices=True)
    common = int(np.minimum(count_a[ia], count_b[ib]).sum())
    return common / (total - common) if total else 1.0
