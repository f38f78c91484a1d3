"""Text embeddings and distance kernels that run inside Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

DIMS = 64
_BREAK = re.compile(r"[\s,.:]+", re.ASCII)


@lru_cache(maxsize=1 << 16)
def _bucket(token: str, dims: int) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:4], 16) % dims


def hashed_embedding(dims: int = DIMS):
    """Unit vectors of hashed term counts: deterministic, offline, no model.

    Any Arrow UDF from text to ``array<double>`` can take its place.
    """

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            terms = [t for t in _BREAK.split((text or "").lower()) if t]
            counts = np.bincount([_bucket(t, dims) for t in terms], minlength=dims).astype(float) if terms else np.zeros(dims)
            norm = np.sqrt((counts * counts).sum())
            out.append(counts / norm if norm else counts)
        return pd.Series(out)

    return embed


def exact_scores(metric: str, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Scores of a few rows, row by row, with one query or one per row: equal rows get equal bits, and near ones do not cancel."""
    if metric == "cosine":
        size = np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum(axis=-1))
        return (rows * query).sum(axis=1) / np.maximum(size, 1e-12)
    return 1.0 / (1.0 + ((rows - query) ** 2).sum(axis=1))


def _sides(metric: str, block: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(queries, rows, error): one matrix product of them gives values that rise with the score.

    For ``l2`` the value is (|q|^2 - squared distance) / 2, for ``cosine`` the cosine. Where 32-bit numbers tell rows
    of this size apart they are taken: the product only chooses candidates, within its largest possible error.
    """
    if metric == "cosine":
        unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)
        left, right, size = unit(queries), unit(block), 1.0
    else:
        squares = (block * block).sum(axis=1)
        left = np.concatenate([queries, np.ones((len(queries), 1))], axis=1)
        right = np.concatenate([block, -0.5 * squares[:, None]], axis=1)
        widest = float(squares.max(initial=0.0))
        size = 1.0 + widest + float((queries * queries).sum(axis=1).max(initial=0.0))
    error = lambda kind: 2 * (left.shape[1] + 8) * float(np.finfo(kind).eps) * size
    kind = np.float32 if error(np.float32) < 1e-3 else np.float64
    return left.astype(kind), right.astype(kind), error(kind)


def _places(found: np.ndarray) -> np.ndarray:
    """Flat places of the few true values: eight are looked at together."""
    flat = found.ravel()
    even = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:even].view(np.uint64))
    near = (words[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([near[flat[near]], even + np.flatnonzero(flat[even:])])


def best_rows(metric: str, ids: np.ndarray, block: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int,
              digits: int | None = None, chunk: int = 2048, lot: int = 256, copies: np.ndarray | None = None) -> pd.DataFrame:
    """Best ``k`` rows of a block per query by exact score; equal scores go to the smaller id.

    ``digits`` rounds scores first, for callers that need equal ranks from other engines.
    A row may stand for ``copies`` rows: those behind better ones that hold ``k`` already are left out.
    The matrix product only chooses candidates: all rows whose score may reach
    the last one needed so far within its rounding error are scored again by difference.
    """
    kept: list[pd.DataFrame] = []
    left, right, error = _sides(metric, block, queries)
    slack = 1e-12 + (10.0 ** -digits if digits is not None else 0.0)
    place_of = np.empty(len(ids), np.int64)
    place_of[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    many = np.ones(len(ids), np.int64) if copies is None else copies
    enough = max(1, -(-k // max(1, int(many.min(initial=k)))))  # as many rows hold k in any case
    begin = min(chunk, max(256, 2 * enough))
    edges = [0, *range(begin, len(ids), chunk), len(ids)]
    held = np.empty((lot, chunk), left.dtype)
    for start in range(0, len(query_ids), lot):
        asked, product = queries[start:start + lot], left[start:start + lot]
        squares = (asked * asked).sum(axis=1)

        def lowest(score, squares):
            """The smallest value of a row whose score may be ``score``."""
            if metric == "cosine":
                return score - slack - error
            least = score - slack
            far = 1.0 / np.where(least > 0, least, 1.0) - 1.0
            return np.where(least > 0, (squares - far) / 2 - error, -np.inf)

        floor = np.full(len(asked), -np.inf)
        held_q, held_r, held_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for first, last in zip(edges, edges[1:], strict=False):
            part = held.ravel()[:len(asked) * (last - first)].reshape(len(asked), last - first)
            np.matmul(product, right[first:last].T, out=part)
            if not first and last > enough:
                value = np.partition(part, last - enough, axis=1)[:, last - enough].astype(np.float64) - error
                floor = lowest(value if metric == "cosine" else 1.0 / (1.0 + np.maximum(squares - 2 * value, 0.0)), squares)
            q, r = np.divmod(_places(part >= floor.astype(part.dtype)[:, None]), last - first)
            if not len(r):
                continue
            r += first
            exact = exact_scores(metric, block[r], asked[q])
            exact = exact if digits is None else np.round(exact, digits)
            held_q, held_r, held_s = np.concatenate([held_q, q]), np.concatenate([held_r, r]), np.concatenate([held_s, exact])
            order = np.lexsort((place_of[held_r], -held_s, held_q))
            held_q, held_r, held_s = held_q[order], held_r[order], held_s[order]
            here = np.arange(len(order))
            new_q = np.r_[True, held_q[1:] != held_q[:-1]]
            new_s = new_q | np.r_[True, held_s[1:] != held_s[:-1]]
            begun = np.maximum.accumulate(np.where(new_q, here, 0))  # where the rows of the query begin
            level = np.maximum.accumulate(np.where(new_s, here, 0))  # and those of its score
            before = np.r_[0, np.cumsum(many[held_r])]
            keep = (here - begun < k) & (before[level] - before[begun] < k)
            total = before[here + 1] - before[begun]
            held_q, held_r, held_s, total = held_q[keep], held_r[keep], held_s[keep], total[keep]
            full = np.r_[held_q[1:] != held_q[:-1], True] & (total >= k)
            floor[held_q[full]] = lowest(held_s[full], squares[held_q[full]])
        kept.append(pd.DataFrame({"query_id": query_ids[start + held_q], "id": ids[held_r], "score": held_s}))
    if not kept:
        return pd.DataFrame({"query_id": query_ids[:0], "id": ids[:0], "score": np.zeros(0)})
    return pd.concat(kept, ignore_index=True)


def partition_search(metric: str, query_ids: np.ndarray, queries: np.ndarray, k: int, digits: int | None = None) -> Callable:
    """Body of ``mapInPandas``: one pass over a partition, best ``k`` per query held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            if not len(batch):
                continue
            found = best_rows(metric, batch["id"].to_numpy(), np.stack(batch["vec"].to_numpy()), query_ids, queries, k, digits)
            held = found if held is None else pd.concat([held, found], ignore_index=True)
            held = held.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id").head(k)
        if held is not None:
            yield held[["query_id", "id", "score"]]

    return run


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of an Arrow column as rows of a matrix; they have one length and none is missing."""
    one = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.min_max(pc.list_value_length(one)).as_py()
    if one.null_count or sizes["min"] != sizes["max"]:
        raise ValueError("vectors need one length")
    return one.flatten().to_numpy(zero_copy_only=False).reshape(len(one), sizes["min"])
