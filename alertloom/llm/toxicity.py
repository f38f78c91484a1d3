"""A counterfactually regularised toxicity classifier on word and word-start features.

Features are the distinct words of a text (A-Z lower-cased) and their first 4, 5
and 6 bytes, as 64-bit hashes. Spark counts in how many toxic and other texts of
the training sample each one occurs and keeps the ``n_features`` with the
largest chi-square; the counts, not the texts, are shuffled. A logistic model is
fitted to them on the driver. Its loss has a further term: in every training
text with an identity term (``IDENTITY_TERMS``) the term is swapped for each
other one of its group and for a neutral word, and the squared change of the raw
score is penalised, so that a mention of a group does not raise the score.

Bound: at most ``max_rows`` labelled documents are used for the fit, those with
the smallest hash of their id; everything else runs over all documents. A score
uses the text only. Null and empty texts get the model's base rate. Rows without
a label, or with a null one, are not learnt from; of several labels of a
document the largest counts. Exact copies in the sample count once. Without any
label of one of the two kinds every score is the smoothed share of toxic ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm import words as W
from alertloom.llm.batches import bounded
from alertloom.session import cut_lineage

MAX_ROWS = 20_000
N_FEATURES = 4096
MIN_SUPPORT = 5
L2 = 1e-4
COUNTERFACTUAL = 1.0
_STARTS = (4, 5, 6)
# fixed values: terms of one group may be swapped for each other
IDENTITY_TERMS = (
    ("woman", "man", "girl", "boy", "transgender"),
    ("women", "men", "girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "queer"),
    ("immigrant", "native", "refugee", "foreigner"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("old", "young", "disabled", "deaf", "blind"),
)


def features(words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature hash) of all words and word starts, with repeats."""
    rows, found = [words.row], [words.hashes()]
    raw = words.data.astype(np.uint64) + np.uint64(1)
    for k in _STARTS:
        long = np.flatnonzero(words.end - words.start > k)
        rows.append(words.row[long])
        found.append(W.mix(W._span_hashes(raw, words.start[long], words.start[long] + k, W._BYTE_BASE[0]) + np.uint64(k)))
    return np.concatenate(rows), np.concatenate(found)


def distinct_pairs(row: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    return row[new], found[new]


def term_features(term: str) -> np.ndarray:
    data = np.frombuffer(term.encode(), dtype=np.uint8)
    return np.unique(features(W.split(data, np.array([0, len(data)]), W.ALNUM, lower=True))[1])


def word_hash(term: str) -> np.uint64:
    data = np.frombuffer(term.encode(), dtype=np.uint8)
    return W.split(data, np.array([0, len(data)]), W.ALNUM, lower=True).hashes()[0]


class Lookup:
    """Positions of hashes in a sorted array, behind a bit table."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.table = np.zeros(1 << 20, dtype=bool)
        self.table[(known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, row: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, position) of the known ones, each pair once."""
        maybe = self.table[(found & np.uint64((1 << 20) - 1)).astype(np.int64)]
        row, found = row[maybe], found[maybe]
        at = np.minimum(np.searchsorted(self.known, found), max(len(self.known) - 1, 0))
        same = self.known[at] == found if len(self.known) else np.zeros(len(found), dtype=bool)
        pairs = np.unique(row[same].astype(np.int64) * (len(self.known) + 1) + at[same])
        return pairs // (len(self.known) + 1), pairs % (len(self.known) + 1)


def _count_rows(batches):
    """(feature, toxic texts, other texts) of a part of the sample, added up per slice."""
    for rows, data, bounds in W.slices(batches, limit=8 * W.SLICE):
        row, found = distinct_pairs(*features(W.split(data, bounds, W.ALNUM, lower=True)))
        toxic = np.array(W.column(rows, "toxic").to_pylist(), dtype=np.int64)[row]
        known, at = np.unique(found, return_inverse=True)
        pos = np.bincount(at, weights=toxic, minlength=len(known)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(W.signed(known)), pa.array(pos), pa.array(np.bincount(at, minlength=len(known)) - pos)],
                                         names=["feature", "pos", "neg"])


@dataclass
class Model:
    known: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float

    def scorer(self):
        lookup = Lookup(self.known)

        def score(words: W.Words) -> np.ndarray:
            raw = np.full(words.n_rows, self.bias)
            row, at = lookup.find(*features(words))
            np.add.at(raw, row, self.weights[at])
            return 1.0 / (1.0 + np.exp(-np.clip(raw, -30, 30)))
        return score


def fit(x: list[np.ndarray], y: np.ndarray, swaps: list[tuple[np.ndarray, np.ndarray]], n_features: int, l2: float = L2,
        counterfactual: float = COUNTERFACTUAL, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias. x: feature positions by row; swaps: (positions that go, positions that come)."""
    row = np.repeat(np.arange(len(x)), [len(a) for a in x])
    at = np.concatenate(x).astype(np.int64) if len(x) else np.zeros(0, dtype=np.int64)
    s_row = np.concatenate([np.full(len(a) + len(b), i) for i, (a, b) in enumerate(swaps)]) if swaps else np.zeros(0, dtype=np.int64)
    s_at = np.concatenate([np.concatenate(s) for s in swaps]).astype(np.int64) if swaps else s_row
    s_sign = np.concatenate([np.r_[-np.ones(len(a)), np.ones(len(b))] for a, b in swaps]) if swaps else np.zeros(0)
    w, b, n = np.zeros(n_features), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), max(1, len(y))
    moment, spread, rate = np.zeros(n_features + 1), np.zeros(n_features + 1), 0.1
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[at], minlength=len(y)) + b, -30, 30)))
        grad = np.bincount(at, weights=(p - y)[row], minlength=n_features) / n + l2 * w
        if swaps:
            change = np.bincount(s_row.astype(np.int64), weights=s_sign * w[s_at], minlength=len(swaps))
            grad += counterfactual * 2 * np.bincount(s_at, weights=s_sign * change[s_row.astype(np.int64)], minlength=n_features) / len(swaps)
        full = np.append(grad, (p - y).mean())
        moment, spread = 0.9 * moment + 0.1 * full, 0.999 * spread + 0.001 * full ** 2
        move = rate * (moment / (1 - 0.9 ** step)) / (np.sqrt(spread / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def _sample_rows(known: np.ndarray, terms: dict[str, int]):
    schema = pa.schema([("toxic", pa.int32()), ("at", pa.list_(pa.int32())), ("terms", pa.list_(pa.int32()))])

    def run(batches):
        lookup = Lookup(known)
        by_hash = sorted((int(word_hash(t)), i) for t, i in terms.items())
        whole, number = Lookup(np.array([h for h, _ in by_hash], dtype=np.uint64)), [i for _, i in by_hash]
        for rows, data, bounds in W.slices(batches):
            words = W.split(data, bounds, W.ALNUM, lower=True)
            row, at = lookup.find(*features(words))
            out: list[list[int]] = [[] for _ in range(words.n_rows)]
            for r, i in zip(row.tolist(), at.tolist(), strict=True):
                out[r].append(i)
            named: list[list[int]] = [[] for _ in range(words.n_rows)]
            for r, i in zip(*(v.tolist() for v in whole.find(words.row, words.hashes())), strict=True):
                named[r].append(number[i])
            yield pa.RecordBatch.from_arrays([pa.array(W.column(rows, "toxic").to_pylist(), pa.int32()), pa.array(out, schema.field("at").type),
                                              pa.array(named, schema.field("terms").type)], schema=schema)
    return run


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", max_rows: int = MAX_ROWS,
          n_features: int = N_FEATURES, min_support: int = MIN_SUPPORT, l2: float = L2, counterfactual: float = COUNTERFACTUAL) -> Model:
    """The model of all given labels, up to ``max_rows`` of them."""
    known_ids = (labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).cast("int").alias("toxic")).where("toxic is not null and doc_id is not null")
                 .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
                 .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    sample = cut_lineage(bounded(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
                         .join(F.broadcast(known_ids), "doc_id").groupBy(F.xxhash64("text").alias("h1"), F.md5("text").alias("h2"))
                         .agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"), "sample")
    totals = sample.groupBy("toxic").count().collect()
    n_pos = sum(r["count"] for r in totals if r["toxic"] > 0)
    n_neg = sum(r["count"] for r in totals if r["toxic"] <= 0)
    if not n_pos or not n_neg:
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), float(np.log((n_pos + 1) / (n_neg + 1))))
    counts = (sample.withColumn("toxic", (F.col("toxic") > 0).cast("int")).mapInArrow(_count_rows, "feature bigint, pos bigint, neg bigint")
              .groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") + F.col("neg") >= min_support))
    share = n_pos / (n_pos + n_neg)
    expected = (F.col("pos") + F.col("neg")) * share
    chi = (F.col("pos") - expected) * (F.col("pos") - expected) / (expected * (1 - share))
    best = counts.withColumn("chi", chi).where("chi >= 10").orderBy(F.desc("chi"), "feature").limit(n_features).collect()
    terms = {t: i for i, t in enumerate(t for group in IDENTITY_TERMS for t in group)}
    known = np.unique(np.concatenate([np.array([r["feature"] for r in best], dtype=np.int64).view(np.uint64), *map(term_features, terms)]))
    rows = sample.withColumn("toxic", (F.col("toxic") > 0).cast("int")).mapInArrow(
        _sample_rows(known, terms), "toxic int, at array<int>, terms array<int>").collect()
    lookup = Lookup(known)
    at_term = [lookup.find(np.zeros(len(f), dtype=np.int64), f)[1] for f in map(term_features, terms)]
    group = {terms[t]: [terms[u] for u in g if u != t] for g in IDENTITY_TERMS for t in g}
    none = np.zeros(0, dtype=np.int64)  # the neutral word has no features
    swaps = [(np.setdiff1d(at_term[t], x), np.setdiff1d(x, at_term[t])) for r in rows for t in r["terms"] for x in [none, *(at_term[u] for u in group[t])]]
    w, b = fit([np.array(r["at"], dtype=np.int64) for r in rows], np.array([r["toxic"] for r in rows], dtype=float), swaps, len(known), l2, counterfactual)
    return Model(known, w, b)


def _score_rows(model, keep: list[str], text: str):
    def run(batches):
        score = model.value.scorer()
        for rows, data, bounds in W.slices(batches, text):
            found = score(W.split(data, bounds, W.ALNUM, lower=True))
            yield pa.RecordBatch.from_arrays([*(W.column(rows, c) for c in keep), pa.array(found)], names=[*keep, "score"])
    return run


def _clean_rows(model, text: str, threshold: float):
    def run(batches):
        score = model.value.scorer()
        for rows, data, bounds in W.slices(batches, text):
            yield rows.filter(pa.array(score(W.split(data, bounds, W.ALNUM, lower=True)) < threshold))
    return run


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` of every document."""
    known = docs.sparkSession.sparkContext.broadcast(model)  # at most n_features and the identity terms
    rows = bounded(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_score_rows(known, ["doc_id"], "text"), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` without those that score ``threshold`` or more; all columns pass through."""
    return bounded(docs).mapInArrow(_clean_rows(docs.sparkSession.sparkContext.broadcast(model), text, threshold), docs.schema)
