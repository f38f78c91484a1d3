"""Near-duplicate classes of documents by banded BagMinHash signatures.

1. One pass over the texts gives each document a hash of its word sequence and a
   signature of the multiset of its k-word shingles (see ``bagminhash``).
2. Documents of equal word sequence are copies; the smallest id stands for them.
3. Signatures are cut into bands. The member of a bucket that shares most bucket
   places is its hub; every document is compared with the best hub of its buckets:
   one pair a document. Links are verified by the exact weighted Jaccard
   similarity of the whole texts; linked documents are one component.
4. What stars cannot see is found exactly: in every bucket whose members belong to
   several components, members of different components are compared, each pair in
   the first band that it shares. Both sides are dealt into blocks of BLOCK rows
   with their texts, so a task holds two blocks and never a bucket, and no pair
   leaves it but the verified links that join components. Pairs inside a
   component need no comparison, as they cannot change the classes.

Signatures only decide which pairs are looked at: a pair of similarity
``threshold`` misses every band with a probability below 1e-5 and has an
estimate below ``threshold - SLACK`` with about 3e-6; no bucket is capped.

Texts without words are in no group, whether null, empty or blank; shorter texts
than a shingle are one shingle. Words are A-Z lower-cased letters and digits.
Repeated rows are copies of each other; different texts of one id are one document,
in the smallest class that one of them belongs to. Rows with a null id are in no
group, and their class is null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm import bagminhash as B
from alertloom.llm import words as W
from alertloom.llm.batches import bounded, fresh, integer_ids
from alertloom.llm.components import components
from alertloom.session import cut_lineage, is_small, settled

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
SLACK = 0.20
#: bytes of text that are verified at once; the shingles of a text take many times its bytes
PART = 1 << 18
#: rows of a bucket in one block
BLOCK = 256
#: ids that may be broadcast to pick texts
MAX_IDS = 1_000_000


def _sketch_rows(k: int, m: int):
    def run(batches):
        for rows, data, bounds in W.slices(batches):
            words = W.split(data, bounds, W.ALNUM, lower=True)
            hashes, first = words.hashes(), words.first()
            row, key, count = B.bags(words, hashes, k)
            signature = B.signatures(row, key, count, words.n_rows, m)
            whole = [W.signed(W.row_hashes(W.mix(hashes + np.uint64(i)), first, i)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [W.column(rows, "doc_id"), pa.array(np.diff(first)), pa.array(whole[0]), pa.array(whole[1]),
                 pa.array([x.tobytes() for x in signature], pa.binary())], names=["doc_id", "n_words", "h1", "h2", "signature"])
    return run


def sketches(docs: DataFrame, k: int = SHINGLE, m: int = BANDS * ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, h1, h2`` (hash of the words) and ``signature`` (m little-endian 32-bit numbers) of every document."""
    rows = bounded(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_sketch_rows(k, m), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, h1 bigint, h2 bigint, signature binary")


def _band_rows(bands: int, rows_in_band: int):
    def run(batches):
        for rows in batches:
            ids, raw = W.column(rows, "doc_id"), W.column(rows, "signature")
            n = len(ids)
            sig = np.frombuffer(b"".join(raw.to_pylist()), dtype=np.uint32).reshape(n, bands, rows_in_band).astype(np.uint64)
            key = np.zeros((n, bands), dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
            for j in range(rows_in_band):
                key = W.mix((key * np.uint64(0x9E3779B97F4A7C15)) ^ sig[:, :, j])
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(np.repeat(np.arange(n), bands))), pa.array(W.signed(key.ravel())), pa.array(np.tile(np.arange(bands, dtype=np.int32), n))],
                names=["doc_id", "key", "band"])
    return run


def _near_rows(threshold: float):
    """Pairs (a, b, signature_a, signature_b) whose estimate reaches the threshold."""
    def run(batches):
        for rows in batches:
            sig = [np.frombuffer(b"".join(W.column(rows, f"signature_{x}").to_pylist()), dtype=np.uint32).reshape(rows.num_rows, -1) for x in "ab"]
            estimate = (sig[0] == sig[1]).mean(axis=1) if rows.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([W.column(rows, "a"), W.column(rows, "b"), pa.array(estimate)],
                                             names=["a", "b", "estimate"]).filter(pa.array(estimate >= threshold))
    return run


def _verify_rows(k: int, threshold: float):
    """Pairs with both texts whose exact weighted Jaccard similarity reaches the threshold."""
    def run(batches):
        for batch in batches:
            for rows, _, _ in W.slices([batch], "text_a", PART):
                bags = [B.bags(*_hashed(W.column(rows, c)), k) for c in ("text_a", "text_b")]
                n = rows.num_rows
                total = sum(np.bincount(r, weights=c, minlength=n) for r, _, c in bags)
                row, key, count = (np.concatenate([bags[0][i], bags[1][i]]) for i in range(3))
                order = np.lexsort((key, row))
                row, key, count = row[order], key[order], count[order]
                same = np.flatnonzero((row[1:] == row[:-1]) & (key[1:] == key[:-1])) if len(row) else np.zeros(0, dtype=np.int64)
                common = np.bincount(row[same], weights=np.minimum(count[same], count[same + 1]), minlength=n)
                like = np.divide(common, total - common, out=np.zeros(n), where=total > 0)
                good = like >= threshold
                yield pa.RecordBatch.from_arrays([W.column(rows, "a"), W.column(rows, "b"), pa.array(like)], names=["a", "b", "similarity"]).filter(pa.array(good))
    return run


def _hashed(texts) -> tuple[W.Words, np.ndarray]:
    words = W.split(*W.text_bytes(texts), W.ALNUM, lower=True)
    return words, words.hashes()


def _block_rows(k: int, threshold: float, rows_in_band: int):
    """Verified links between components from one pair of blocks of a bucket."""
    def run(group: pa.Table) -> pa.Table:
        doc, comp, side = (group[c].to_numpy() for c in ("doc_id", "comp", "side"))
        band = group["band"][0].as_py()
        sig = np.frombuffer(b"".join(group["signature"].to_pylist()), dtype=np.uint32).reshape(len(doc), -1)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        pairs: list[tuple[float, int, int]] = []
        for i in left:
            same = sig[right] == sig[i]
            like = same.mean(axis=1)
            near = np.flatnonzero((like >= threshold - SLACK) & (comp[right] != comp[i]))
            first = same[near].reshape(len(near), -1, rows_in_band).all(axis=2).argmax(axis=1) == band if len(near) else near
            pairs += [(float(like[j]), int(i), int(right[j])) for j in near[first]]
        links = []
        if pairs:
            row, key, count = B.bags(*_hashed(group["text"].combine_chunks()), k)
            bounds = np.searchsorted(row, np.arange(len(doc) + 1))
            bag = [(key[a:b], count[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            root = {c: c for c in comp.tolist()}

            def find(c):
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            for _, i, j in sorted(pairs, reverse=True):
                x, y = find(int(comp[i])), find(int(comp[j]))
                if x != y and B.weighted_jaccard(*bag[i], *bag[j]) >= threshold:
                    root[max(x, y)] = min(x, y)
                    links.append((min(int(doc[i]), int(doc[j])), max(int(doc[i]), int(doc[j]))))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})
    return run


def _estimated(pairs: DataFrame, sketch: DataFrame, threshold: float) -> DataFrame:
    """``a, b, estimate`` of the pairs whose signatures reach the threshold."""
    s = sketch.select("doc_id", "signature")
    both = (pairs.join(s.withColumnsRenamed({"doc_id": "a", "signature": "signature_a"}), "a")
            .join(s.withColumnsRenamed({"doc_id": "b", "signature": "signature_b"}), "b"))
    return both.mapInArrow(_near_rows(threshold), "a bigint, b bigint, estimate double").distinct()


def _texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, text`` of the given ids (``id``, each once), without a shuffle of all texts while they are few."""
    return texts.join(F.broadcast(ids) if is_small(ids, MAX_IDS) else ids, F.col("doc_id") == F.col("id"), "left_semi")


def _verified(pairs: DataFrame, texts: DataFrame, sketch: DataFrame, k: int, threshold: float) -> DataFrame:
    """``a, b`` of the pairs at or over the threshold."""
    pairs = cut_lineage(_estimated(pairs, sketch, threshold - SLACK).select("a", "b"), "pairs")
    ids = cut_lineage(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    wanted = _texts_of(texts, ids)
    whole = (pairs.join(wanted.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")
             .join(wanted.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b"))
    return cut_lineage(whole.mapInArrow(_verify_rows(k, threshold), "a bigint, b bigint, similarity double").select("a", "b").distinct(), "links")


def _cross_links(members: DataFrame, texts: DataFrame, sketch: DataFrame, k: int, threshold: float) -> DataFrame:
    """``a, b``: verified links between components that share a bucket.

    members: ``key, band, doc_id, comp`` of buckets with several components. Only
    rows outside the bucket's most frequent component are left sides.
    """
    sizes = members.groupBy("key", "comp").count()
    top = cut_lineage(sizes.groupBy("key").agg(F.max(F.struct("count", "comp")).alias("m"), F.sum("count").alias("n")).select(
        "key", F.col("m.comp").alias("top"), (F.col("n") - F.col("m.count")).alias("n_left"), "n"), "tops")
    ids = cut_lineage(members.select(F.col("doc_id").alias("id")).distinct(), "ids")

    def blocks(n):
        return F.ceil(F.col(n) / BLOCK).cast("int")

    def slot(n):
        return F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    rows = members.join(top, "key").select("key", "band", "doc_id", "comp", "top", blocks("n_left").alias("lefts"), blocks("n").alias("rights"))
    sides = rows.where("comp <> top").select("key", "band", "doc_id", "comp", F.lit(0).alias("side"), slot("lefts").alias("i"), every("rights").alias("j")).unionByName(
        rows.select("key", "band", "doc_id", "comp", F.lit(1).alias("side"), every("lefts").alias("i"), slot("rights").alias("j")))
    loads = _texts_of(texts, ids).join(sketch, "doc_id")
    return sides.join(loads, "doc_id").groupBy("key", "i", "j").applyInArrow(_block_rows(k, threshold, ROWS), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, class_id, copy_of, n_links``, one row per row of ``docs``.

    ``class_id`` is the smallest id of the connected component of documents at or
    over the threshold, ``copy_of`` the smallest id with the same words, and
    ``n_links`` the number of verified links of that representative; pairs that
    other links had joined before are not verified and not counted.
    """
    return settled(docs.sparkSession, "classes", lambda: _classes(docs, k, threshold, doc_id, text))


def _classes(docs: DataFrame, k: int, threshold: float, doc_id: str, text: str) -> DataFrame:
    rows = bounded(integer_ids(docs, doc_id)).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    sketch = cut_lineage(sketches(rows, k), "sketches")
    full = sketch.where("n_words > 0 and doc_id is not null")
    first = cut_lineage(full.groupBy("h1", "h2", "n_words").agg(F.min("doc_id").alias("copy_of")), "firsts")  # so that a hot group can be split
    copies = cut_lineage(full.join(first, ["h1", "h2", "n_words"]).select("doc_id", "copy_of").distinct(), "copies")
    reps = full.join(copies.where("doc_id = copy_of").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id", "h1", "h2"])
    reps = cut_lineage(reps.select("doc_id", "signature"), "representatives")
    places = cut_lineage(reps.mapInArrow(_band_rows(BANDS, ROWS), "doc_id bigint, key bigint, band int"), "bands")
    shared = cut_lineage(places.groupBy("key").count().where("count > 1"), "shared")
    members = cut_lineage(places.join(shared, "key").distinct(), "buckets")  # doc_id, key, band, count
    degree = cut_lineage(members.groupBy("doc_id").agg(F.sum("count").alias("degree")), "degrees")
    hubs = cut_lineage(members.join(degree, "doc_id").groupBy("key").agg(F.max(F.struct("degree", (-F.col("doc_id")).alias("low"))).alias("h")), "hubs")
    best = (members.join(hubs, "key").where(F.col("doc_id") != -F.col("h.low")).groupBy("doc_id").agg(F.max("h").alias("h"))
            .select("doc_id", (-F.col("h.low")).alias("hub")))
    star = best.select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()
    found = _verified(star, rows, reps, k, threshold)
    root = components(found)
    known = cut_lineage(members.join(root, members["doc_id"] == root["node"], "left").select("key", "band", "doc_id", F.coalesce("root", "doc_id").alias("comp")), "known")
    mixed = cut_lineage(known.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key"), "mixed")
    if not mixed.isEmpty():
        cross = _cross_links(cut_lineage(known.join(mixed, "key"), "mixed"), rows, reps, k, threshold)
        found = found.unionByName(cut_lineage(cross, "links")).distinct()
        root = components(found)
    ends = found.select(F.col("a").alias("copy_of")).unionByName(found.select(F.col("b").alias("copy_of"))).groupBy("copy_of").agg(F.count("*").alias("n_links"))
    classes = (copies.join(root.withColumnsRenamed({"node": "copy_of", "root": "class_id"}), "copy_of", "left").join(ends, "copy_of", "left")
               .select("doc_id", F.coalesce("class_id", "copy_of").alias("class_id"), "copy_of", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")))
    classes = classes.groupBy("doc_id").agg(F.min(F.struct("class_id", "copy_of", "n_links")).alias("c")).select("doc_id", "c.*")
    return (sketch.select("doc_id").join(classes, "doc_id", "left")
            .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"),
                    F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")))


def keep_first(docs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of every class, the one of smallest id; all columns pass through.

    Rows that repeat the id and the text of another row go. The ids of the rows
    to drop are broadcast while they are few, so that texts are not shuffled.
    """
    classes = near_duplicates(docs, k, threshold, doc_id, text)
    own, = fresh(docs.columns, "other")
    gone = cut_lineage(classes.where("doc_id <> class_id").select(F.col("doc_id").alias(own)).distinct(), "gone")
    few = F.broadcast(gone) if is_small(gone, MAX_IDS) else gone
    left = docs.join(few, F.col(f"`{doc_id}`").cast("bigint") == F.col(own), "left_anti")
    again = left.select(F.col(f"`{doc_id}`").alias(own)).where(F.col(own).isNotNull()).groupBy(own).agg(F.count("*").alias("n")).where("n > 1").select(own)
    again = cut_lineage(again, "again")
    if again.isEmpty():
        return left
    repeats = left.join(again, F.col(f"`{doc_id}`") == F.col(own), "left_semi").dropDuplicates([doc_id, text])
    return left.join(again, F.col(f"`{doc_id}`") == F.col(own), "left_anti").unionByName(repeats)
