"""Language by prediction by partial matching over bytes.

Every language has a context tree of its own: how often each byte followed each
context of up to ``order`` bytes in its training texts. The code length of a text is the
sum over its bytes of -log2 p, where p comes from the longest context that the
tree knows. A context that has not seen the byte costs an escape, d / (n + d)
for n occurrences of d different bytes, and the next shorter context goes on without the
bytes that were ruled out; behind the empty context the bytes left are equally
likely. A text gets the language of its shortest code. The statistics are frozen:
scoring never updates them, so every text is scored alike and on its own.

Counting reads all training texts: each task counts the longest contexts of its
part, Spark sums them, and the shorter ones are sums over their longer ones. Trees
are of variable order: of the nodes of all languages those that occur at least ``k`` times are
kept, where k is the smallest number for which they are at most ``max_nodes`` (single
bytes, at most 256 a language, always stay). A context occurs as often as its
extensions together, so what is kept is closed under shortening. Only the kept
nodes reach the driver and the workers.

Texts that are null or hold no letter are ``und`` with a score of 0, and so is every
text when nothing could be learnt. Equal code lengths: the language first by name.
Training rows of null text or language teach nothing; repeated rows count each time they
occur. ``score`` is the share of the chosen language when each is weighed by
2^-(code length). Very long texts are coded whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm import words as W
from alertloom.llm.batches import bounded
from alertloom.session import cut_lineage, own_tables

ORDER = 4
#: a gram is a 56-bit integer of up to 7 bytes, and its number of bytes above
LONGEST = 6
MAX_NODES = 400_000
UNKNOWN = "und"
_COUNT_SLICE, _SCORE_SLICE = 8 << 20, 2 << 20
_BYTES = (1 << 56) - 1


def _low(size: int) -> np.uint64:
    return np.uint64((1 << (8 * size)) - 1)


def _name(size: int) -> np.uint64:
    return np.uint64(size << 56)


def grams(data: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram, row) of every byte: the byte and up to ``order`` bytes of its row before it."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    behind = np.minimum(np.arange(len(data)) - bounds[row], order).astype(np.uint64)
    out = data.astype(np.uint64)
    for k in range(1, order + 1):
        out[k:] |= data[:-k].astype(np.uint64) << np.uint64(8 * k)
    out &= (np.uint64(1) << (np.uint64(8) * (behind + np.uint64(1)))) - np.uint64(1)
    return out | (behind + np.uint64(1)) << np.uint64(56), row


def _count_rows(order: int):
    def run(batches):
        for rows, data, bounds in W.slices(batches, limit=_COUNT_SLICE):
            found, row = grams(data, bounds, order)
            lang = W.column(rows, "lang").dictionary_encode()
            code = lang.indices.to_numpy(zero_copy_only=False)[row]
            for i, name in enumerate(lang.dictionary.to_pylist()):
                known, n = np.unique(found[code == i], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(known), pa.string()), pa.array(known.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
    return run


def _tails(gram: Column) -> Column:
    """A gram and all its shortenings to its last bytes."""
    return F.transform(F.sequence(F.lit(1), F.shiftright(gram, 56).cast("int")), lambda k: F.call_function(
        "shiftleft", k.cast("bigint"), F.lit(56)).bitwiseOR(gram.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), k * 8) - 1)))


def count(docs: DataFrame, order: int = ORDER, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang, gram, n``: occurrences of all grams of 1 to ``order`` + 1 bytes in the texts of each language."""
    if not 0 <= order <= LONGEST - 1:
        raise ValueError(f"order must lie between 0 and {LONGEST - 1}")
    rows = bounded(docs).select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    longest = rows.mapInArrow(_count_rows(order), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return longest.select("lang", F.explode(_tails(F.col("gram"))).alias("gram"), "n").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Tree:
    """The frozen context tree of one language."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        order = np.argsort(gram)
        self.gram, self.n = gram[order], n[order].astype(np.float64)
        size = self.gram >> np.uint64(56)
        context = (size - np.uint64(1)) << np.uint64(56) | (self.gram & np.uint64(_BYTES)) >> np.uint64(8)
        self.context, node = np.unique(context, return_inverse=True)
        self.total = np.bincount(node, weights=self.n, minlength=len(self.context))
        self.different = np.bincount(node, minlength=len(self.context)).astype(np.float64)
        # what the bytes of a context count in the context that is shorter by one
        drop = np.uint64(8) * (np.maximum(size, np.uint64(1)) - np.uint64(1))
        tail = (size - np.uint64(1)) << np.uint64(56) | self.gram & ((np.uint64(1) << drop) - np.uint64(1))
        self.ruled_out = np.bincount(node, weights=np.where(size > 1, self._counts(tail), 0.0), minlength=len(self.context))

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def _counts(self, gram: np.ndarray) -> np.ndarray:
        at, known = self._find(self.gram, gram)
        return np.where(known, self.n[at], 0.0) if len(self.gram) else np.zeros(len(gram))

    def bits(self, gram: np.ndarray, order: int) -> np.ndarray:
        """Code length of the last byte of each gram behind the bytes before it."""
        size = (gram >> np.uint64(56)).astype(np.int64)
        out = np.zeros(len(gram))
        gone_n, gone_d = np.zeros(len(gram)), np.zeros(len(gram))
        todo = np.arange(len(gram))
        for k in range(order, -1, -1):
            at = todo[size[todo] > k]
            if not len(at):
                continue
            here = gram[at]
            node, known = self._find(self.context, _name(k) | (here >> np.uint64(8)) & _low(k))
            at, here, node = at[known], here[known], node[known]
            n, d = self.total[node] - gone_n[at], self.different[node] - gone_d[at]
            c = self._counts(_name(k + 1) | here & _low(k + 1))
            hit = c > 0
            miss = ~hit & (d > 0)
            out[at[hit]] += np.log2(n[hit] + d[hit]) - np.log2(c[hit])
            out[at[miss]] += np.log2(n[miss] + d[miss]) - np.log2(d[miss])
            gone_n[at], gone_d[at] = self.ruled_out[node], self.different[node]
            done = np.zeros(len(gram), dtype=bool)
            done[at[hit]] = True
            todo = todo[~done[todo]]
        root = self.different[0] if len(self.context) and self.context[0] == 0 else 0.0
        out[todo] += np.log2(max(256.0 - root, 1.0))
        return out


class Model:
    """Context trees by language."""

    def __init__(self, trees: dict[str, Tree], order: int):
        self.langs, self.order = sorted(trees), order
        self.trees = [trees[lang] for lang in self.langs]

    def code_lengths(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bits of every row (first axis) in every language."""
        found, row = grams(data, bounds, self.order)
        different, where = np.unique(found, return_inverse=True)
        return np.stack([np.bincount(row, weights=tree.bits(different, self.order)[where], minlength=len(bounds) - 1) for tree in self.trees], axis=1)


def train(docs: DataFrame, order: int = ORDER, max_nodes: int = MAX_NODES, lang: str = "lang", text: str = "text") -> Model:
    """The frozen model of all rows of ``docs`` that have a text and a language."""
    with own_tables(docs.sparkSession):
        return _frozen(docs, order, max_nodes, lang, text)


def _frozen(docs: DataFrame, order: int, max_nodes: int, lang: str, text: str) -> Model:
    nodes = cut_lineage(count(docs, order, lang, text), "context-counts")
    step = F.floor(F.log2("n") * 16).alias("step")  # some hundred steps, whatever the counts
    sizes = sorted(((r["step"], r["nodes"]) for r in nodes.groupBy(step).agg(F.count("*").alias("nodes")).collect()), reverse=True)
    least, total = 0, 0
    for s, n in sizes:
        total += n
        if total > max_nodes:
            least = s + 1
            break
    kept = nodes.where((F.floor(F.log2("n") * 16) >= least) | (F.shiftright("gram", 56) == 1)).toArrow()  # at most max_nodes + 256 a language
    by_lang: dict[str, Tree] = {}
    names, gram, n = np.array(kept["lang"].to_pylist(), dtype=object), kept["gram"].to_numpy(), kept["n"].to_numpy()
    for name in sorted(set(names)):
        own = names == name
        by_lang[name] = Tree(gram[own].view(np.uint64), n[own])
    return Model(by_lang, order)


def _score_rows(model):
    def run(batches):
        known = model.value
        for rows, data, bounds in W.slices(batches, limit=_SCORE_SLICE):
            letters = W.column(rows, "letters").to_pylist()
            bits = known.code_lengths(data, bounds) if known.langs else np.zeros((rows.num_rows, 0))
            chosen = bits.argmin(axis=1) if known.langs else np.zeros(rows.num_rows, dtype=np.int64)
            weight = np.exp2(bits.min(axis=1, keepdims=True) - bits) if known.langs else bits
            share = 1.0 / weight.sum(axis=1) if known.langs else np.zeros(rows.num_rows)
            ok = [bool(x) and bool(known.langs) for x in letters]
            yield pa.RecordBatch.from_arrays([
                W.column(rows, "doc_id"), pa.array([known.langs[i] if good else UNKNOWN for i, good in zip(chosen.tolist(), ok, strict=True)], pa.string()),
                pa.array(np.where(ok, share, 0.0)), pa.array([dict(zip(known.langs, x, strict=True)) for x in bits.tolist()], pa.map_(pa.string(), pa.float64()))],
                names=["doc_id", "lang_pred", "score", "bits"])
    return run


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, bits``: the language of every text and its code length in each."""
    rows = bounded(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    known = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_score_rows(known), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, bits map<string,double>")
