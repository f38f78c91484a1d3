"""Substring deduplication by relative Lempel-Ziv parsing over word blocks.

The reference of a document is all text before it (smaller id, or earlier in the
same document), in blocks of one task's documents. A factor is a run of words
copied from one place of the reference; factors of ``n`` or more words are
duplicate spans, all other words are literals.

1. Copies: documents of equal word sequence are found by hash. All but the
   smallest id are one factor each, and take no part in what follows.
2. Index: of every ``n`` consecutive words one block of ANCHOR words, the one of
   smallest hash, is an anchor. Equal runs of ``n`` words have equal anchors, so
   only runs whose anchors all occur twice in the corpus can be repeated.
3. Factors: documents with such runs are read again. In each part of the corpus
   (a block of about PART bytes) every run is looked up among the earlier runs of
   the part; the first of its kind goes on to meet those of the other parts, at
   most one row per part and kind, so a passage that very many documents share
   stays small. A run with an earlier one is a reference (document, position).
4. Boundaries: consecutive runs with consecutive references are one factor. Where
   the reference changes, the runs across the boundary have been checked one by
   one like all others, so what greedy factors alone would miss is covered.

Runs are compared by two independent 64-bit hashes. Words are what stands
between blanks, unchanged. Null and empty texts have no words. Equal rows are one
document and have equal results; of different texts with one id, the one with
the smallest hash takes part, the others keep all their words. Rows with a null id
keep all their words and are nobody's reference.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertloom.llm import words as W
from alertloom.llm.batches import bounded, integer_ids
from alertloom.session import cut_lineage, is_small

N_WORDS = 20
ANCHOR = 5
#: bytes of text in one part of the corpus
PART = 16 << 20
#: ids that may be broadcast to pick texts
MAX_IDS = 1_000_000


def anchors(words: W.Words, hashes: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the blocks of smallest hash among every n words, each place once."""
    at, found = W.windows(hashes, words.row, size)
    span = n - size + 1
    if len(found) < span:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    row = words.row[at]
    starts = np.flatnonzero(row[: len(row) - span + 1] == row[span - 1:])
    place, width = np.arange(len(found)), 1

    def lower(a, b):  # the leftmost of equals
        return np.where(found[b] < found[a], b, a)

    while width * 2 <= span:  # place of the smallest of the next ``width`` blocks, doubling
        place = lower(place[: len(place) - width], place[width:])
        width *= 2
    chosen = np.unique(lower(place[starts], place[starts + span - width]))
    return row[chosen], found[chosen]


def _index_rows(n: int, size: int):
    def run(batches):
        for rows, data, bounds in W.slices(batches):
            words = W.split(data, bounds, W.NON_BLANK)
            hashes, first = words.hashes(), words.first()
            row, found = anchors(words, hashes, n, size)
            ends = np.searchsorted(row, np.arange(words.n_rows + 1)).astype(np.int32)
            whole = _row_names(hashes, first)
            yield pa.RecordBatch.from_arrays(
                [W.column(rows, "doc_id"), pa.array(np.diff(first)), pa.array(whole[0]), pa.array(whole[1]),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(W.signed(found)))], names=["doc_id", "n_words", "h1", "h2", "anchors"])
    return run


def _row_names(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two hashes of the word sequence of every row."""
    return [W.signed(W.row_hashes(W.mix(hashes + np.uint64(i)), first, i)) for i in (0, 1)]


def _is_named(rows: pa.RecordBatch, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows whose words are those that h1 and h2 stand for."""
    return np.logical_and(*(W.column(rows, c).to_numpy(zero_copy_only=False) == x for c, x in zip(("h1", "h2"), _row_names(hashes, first), strict=True)))


def _chains(doc, at, ref_doc, ref_at) -> np.ndarray:
    """Starts of the chains of consecutive runs with consecutive references; rows sorted by doc, at."""
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1) | (ref_doc[1:] != ref_doc[:-1]) | (ref_at[1:] != ref_at[:-1] + 1)
    return np.flatnonzero(new)


def _run_rows(n: int, size: int):
    """Runs that may be repeated: the first of each kind in this part, and chains of those found in it.

    A row is (h1, h2, doc_id, at, length, ref_doc, ref_at); ref_doc is null for
    the firsts. Chains get their own place as hashes.
    """
    names = ["h1", "h2", "doc_id", "at", "length", "ref_doc", "ref_at"]

    def emit(parts):
        h1, h2, doc, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((at, doc, h2, h1))
        h1, h2, doc, at = h1[order], h2[order], doc[order], at[order]
        once = np.ones(len(h1), dtype=bool)  # equal rows of the table
        once[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])
        h1, h2, doc, at = h1[once], h2[once], doc[once], at[once]
        first = np.ones(len(h1), dtype=bool)
        first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        owner = np.flatnonzero(first)[np.cumsum(first) - 1]
        later = np.flatnonzero(~first)
        yield pa.RecordBatch.from_arrays(
            [pa.array(W.signed(h1[first])), pa.array(W.signed(h2[first])), pa.array(doc[first]), pa.array(at[first].astype(np.int32)),
             pa.array(np.ones(first.sum(), dtype=np.int32)), pa.nulls(first.sum(), pa.int64()), pa.nulls(first.sum(), pa.int32())], names=names)
        if len(later):
            later = later[np.lexsort((at[later], doc[later]))]
            ref = owner[later]
            begin = _chains(doc[later], at[later], doc[ref], at[ref])
            length = np.diff(np.append(begin, len(later)))
            x, r = later[begin], ref[begin]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[x]), pa.array(at[x].astype(np.int64)), pa.array(doc[x]), pa.array(at[x].astype(np.int32)),
                 pa.array(length.astype(np.int32)), pa.array(doc[r]), pa.array(at[r].astype(np.int32))], names=names)

    def run(batches):
        parts, held = [], 0
        for rows, data, bounds in W.slices(batches):
            words = W.split(data, bounds, W.NON_BLANK)
            hashes, first = words.hashes(), words.first()
            ids = W.column(rows, "doc_id").to_numpy(zero_copy_only=False)
            column = W.column(rows, "anchors")
            known_row = np.repeat(np.arange(words.n_rows), column.value_lengths().to_numpy(zero_copy_only=False))
            known = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            # a block of this row that is one of its repeated anchors
            at, found = W.windows(hashes, words.row, size)
            row = words.row[at]
            order = np.lexsort((known, known_row))
            pair = W.mix(known[order] + known_row[order].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            pair.sort()
            mine = W.mix(found + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            hit = np.zeros(len(mine), dtype=bool)
            if len(pair):
                hit = pair[np.minimum(np.searchsorted(pair, mine), len(pair) - 1)] == mine
            block_hit = np.zeros(len(hashes), dtype=bool)
            block_hit[at[hit]] = True
            # the anchor of every run of n words, and whether it is a repeated one
            value = np.full(len(hashes), np.iinfo(np.uint64).max, dtype=np.uint64)
            value[at] = found
            starts, h1 = W.windows(hashes, words.row, n)
            if len(starts):
                span, low, width = n - size + 1, value, 1
                while width * 2 <= span:
                    low = np.minimum(low[: len(low) - width], low[width:])
                    width *= 2
                least = np.minimum(low[starts], low[starts + span - width])
                # equal hashes are equal blocks, so any block of the smallest hash tells for all
                any_hit = np.where(block_hit, value, np.iinfo(np.uint64).max)
                low, width = any_hit, 1
                while width * 2 <= span:
                    low = np.minimum(low[: len(low) - width], low[width:])
                    width *= 2
                maybe = (np.minimum(low[starts], low[starts + span - width]) == least) & _is_named(rows, hashes, first)[words.row[starts]]
                starts, h1 = starts[maybe], h1[maybe]
                h2 = W._span_hashes(W.mix(hashes + np.uint64(1)), starts, starts + n, W._WORD_BASE[1])
                parts.append((h1, h2, ids[words.row[starts]], starts - first[words.row[starts]]))
            held += len(data)
            if held >= PART and parts:
                yield from emit(parts)
                parts, held = [], 0
        if parts:
            yield from emit(parts)
    return run


def _spans_rows(n: int):
    """One row per document: chains of (at, ref), merged into factors."""
    def run(group: pa.Table) -> pa.Table:
        doc = group["doc_id"].to_numpy()
        at, length, ref_doc, ref_at = (group[c].to_numpy() for c in ("at", "length", "ref_doc", "ref_at"))
        order = np.argsort(at, kind="stable")
        at, length, ref_doc, ref_at = at[order], length[order], ref_doc[order], ref_at[order]
        joined = np.ones(len(at), dtype=bool)
        joined[1:] = (at[1:] != at[:-1] + length[:-1]) | (ref_doc[1:] != ref_doc[:-1]) | (ref_at[1:] != ref_at[:-1] + length[:-1])
        begin = np.flatnonzero(joined)
        ends = np.append(begin[1:], len(at)) - 1
        factors = [{"start": int(at[b]), "n_words": int(at[e] + length[e] - at[b] + n - 1), "ref_doc": int(ref_doc[b]), "ref_start": int(ref_at[b])}
                   for b, e in zip(begin, ends, strict=True)]
        return pa.table({"doc_id": pa.array([doc[0]], pa.int64()), "factors": pa.array([factors], pa.list_(pa.struct(
            [("start", pa.int32()), ("n_words", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())])))})
    return run


_FACTORS = "array<struct<start:int,n_words:int,ref_doc:bigint,ref_start:int>>"


def _picked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` whose doc_id is in ``ids`` (doc_id, each once), without a shuffle of texts while the ids are few."""
    return rows.join(F.broadcast(ids) if is_small(ids, MAX_IDS) else ids, "doc_id", "left_semi")


def factors(docs: DataFrame, n: int = N_WORDS, anchor: int = ANCHOR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, h1, h2, factors``: documents with duplicate spans; places are word numbers.

    ``h1, h2`` name the text among several of one id.
    """
    rows = bounded(integer_ids(docs, doc_id)).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    index = cut_lineage(rows.where("doc_id is not null").mapInArrow(_index_rows(n, anchor), "doc_id bigint, n_words bigint, h1 bigint, h2 bigint, anchors array<bigint>"), "blocks")
    own = index.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("own"))  # one text of an id takes part
    long = index.join(own, "doc_id").where((F.col("n_words") >= n) & (F.col("own.h1") == F.col("h1")) & (F.col("own.h2") == F.col("h2"))).dropDuplicates(["doc_id"]).drop("own")
    first = cut_lineage(long.groupBy("h1", "h2", "n_words").agg(F.min("doc_id").alias("ref_doc")), "firsts")  # so that a hot group can be split
    copies = cut_lineage(long.drop("anchors").join(first, ["h1", "h2", "n_words"]).select("doc_id", "h1", "h2", "n_words", "ref_doc"), "copies")
    gone = copies.where("doc_id <> ref_doc")
    reps = long.join(copies.where("doc_id = ref_doc").select("doc_id"), "doc_id", "left_semi")
    blocks = reps.select("doc_id", F.explode("anchors").alias("anchor"))
    twice = cut_lineage(blocks.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "twice")
    found = (blocks.join(twice, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
             .join(copies.select("doc_id", "h1", "h2"), "doc_id"))
    found = cut_lineage(found, "repeated")
    runs = (_picked(rows, found.select("doc_id")).join(found, "doc_id")
            .mapInArrow(_run_rows(n, anchor), "h1 bigint, h2 bigint, doc_id bigint, at int, length int, ref_doc bigint, ref_at int"))
    kind = Window.partitionBy("h1", "h2", F.col("ref_doc").isNotNull())  # a kind has at most one row per part
    earliest = F.min(F.struct("doc_id", "at")).over(kind)
    matched = (runs.withColumn("first", earliest)
               .where("ref_doc is not null or first.doc_id < doc_id or first.at < at")
               .select("doc_id", "at", "length", F.coalesce("ref_doc", "first.doc_id").alias("ref_doc"), F.coalesce("ref_at", "first.at").alias("ref_at")))
    parsed = (matched.groupBy("doc_id").applyInArrow(_spans_rows(n), f"doc_id bigint, factors {_FACTORS}")
              .join(copies.select("doc_id", "h1", "h2"), "doc_id").select("doc_id", "h1", "h2", "factors"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("n_words"), "ref_doc", F.lit(0).alias("ref_start")))
    return cut_lineage(parsed.unionByName(gone.select("doc_id", "h1", "h2", whole.alias("factors"))), "factors")


def _cut_rows(batches):
    for rows, data, bounds in W.slices(batches):
        words = W.split(data, bounds, W.NON_BLANK)
        first, blank = words.first(), b" "
        raw = data.tobytes()
        n_removed, digests = [], []
        lists = [None] * rows.num_rows
        if "factors" in rows.schema.names:
            named = _is_named(rows, words.hashes(), first)
            lists = [x if good else None for x, good in zip(W.column(rows, "factors").to_pylist(), named.tolist(), strict=True)]
        for r in range(words.n_rows):
            a, b = first[r], first[r + 1]
            start, end = words.start[a:b], words.end[a:b]
            if lists[r]:
                gone = np.zeros(b - a + 1, dtype=np.int64)
                for f in lists[r]:
                    gone[f["start"]] += 1
                    gone[f["start"] + f["n_words"]] -= 1
                keep = np.cumsum(gone[:-1]) == 0
                start, end = start[keep], end[keep]
            n_removed.append(int(b - a - len(start)))
            digests.append(hashlib.sha256(blank.join([raw[x:y] for x, y in zip(start.tolist(), end.tolist(), strict=True)])).hexdigest())
        yield pa.RecordBatch.from_arrays([W.column(rows, "doc_id"), pa.array(np.diff(first)), pa.array(n_removed, pa.int64()), pa.array(digests)],
                                         names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def removals(docs: DataFrame, n: int = N_WORDS, anchor: int = ANCHOR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document."""
    rows = bounded(integer_ids(docs, doc_id)).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    found = factors(rows, n, anchor)
    ids = found.select("doc_id")
    small = is_small(ids, MAX_IDS)
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    if small:
        with_factors = rows.join(F.broadcast(ids), "doc_id", "left_semi").join(found, "doc_id")
        without = rows.join(F.broadcast(ids), "doc_id", "left_anti")
        return with_factors.mapInArrow(_cut_rows, schema).unionByName(without.mapInArrow(_cut_rows, schema))
    return rows.join(found, "doc_id", "left").mapInArrow(_cut_rows, schema)
