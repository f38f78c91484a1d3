"""Benchmark decontamination by a broadcast set of test n-grams.

The windows of the benchmark (``n`` consecutive normalised words; an item of
fewer words is one window) are a hash set. Each document is scanned once: its
windows are hashed from prefix sums, probed, and every hit is verified as text.

Up to ``max_grams`` windows and MAX_BYTES of items the set is broadcast: sorted
hashes, and the words of the items once, of which a window is a slice. A larger
benchmark gives the same results by joins: windows that pass a bit table of
fixed size leave the scan as hashes, only of the sizes that occur, and meet the
hashes of the benchmark; texts with hits are then read once more to verify them.
Both ways serve the removal of documents and of spans.

Null and empty texts have no words and no hits. Repeated rows are judged each
by itself; equal items are all reported. Words found by an item without an id
are hit, but the item is not listed. An empty benchmark hits nothing.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm import words as W
from alertloom.llm.batches import bounded, fresh
from alertloom.session import is_small

N_WORDS = 13
MAX_GRAMS = 1_000_000
#: of the items of a broadcast benchmark
MAX_BYTES = 64 << 20
#: 64-bit words of the bit table in front of the joins (8 MB)
BIT_WORDS = 1 << 20
_GRAM = "item string, size int, hash bigint, gram string"
_HITS = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,end:int>>"
_SPANS = "array<struct<start:int,end:int>>"


def _gram_rows(n: int):
    def run(batches):
        for rows, data, bounds in W.slices(batches):
            words = W.split(data, bounds, W.ALNUM, lower=True)
            first, hashes = words.first(), words.hashes()
            items = W.column(rows, "item").to_pylist()
            out = []
            for r in range(words.n_rows):
                size = min(n, int(first[r + 1] - first[r]))
                if not size:
                    continue
                at, found = W.windows(hashes[first[r]: first[r + 1]], words.row[first[r]: first[r + 1]], size)
                out += [(items[r], size, int(h), " ".join(words.text(first[r] + i + j) for j in range(size)))
                        for i, h in zip(at.tolist(), W.signed(found), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(
                (pa.string(), pa.int32(), pa.int64(), pa.string()))], names=["item", "size", "hash", "gram"])
    return run


def benchmark_grams(benchmark: DataFrame, n: int = N_WORDS, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row per distinct (item, window): ``item, size, hash, gram``."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    return items.mapInArrow(_gram_rows(n), _GRAM).distinct()


def joined(words: W.Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(all words with one blank behind each, first and last + 1 byte of every word in it)."""
    size = words.end - words.start
    first = np.cumsum(size + 1) - (size + 1)
    out = np.full(int((size + 1).sum()), 0x20, dtype=np.uint8)
    source = np.flatnonzero(W.ALNUM[words.data])
    out[np.repeat(first - words.start, size) + source] = words.data[source]
    return out.tobytes(), first, first + size


class GramSet:
    """The windows of some items: sorted hashes by size, behind a bit table that turns away most probes."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        data, bounds = W.text_bytes(pa.array([text for _, text in items], pa.large_string()))
        words = W.split(data, bounds, W.ALNUM, lower=True)
        hashes, sizes = words.hashes(), np.minimum(words.counts(), n)
        self.items, self.item = [item for item, _ in items], words.row.astype(np.int32)
        self.text, self.first, self.last = joined(words)
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted(set(sizes[sizes > 0].tolist())):
            at, found = W.windows(hashes, words.row, size)
            own = sizes[words.row[at]] == size
            at, found = at[own], found[own]
            order = np.argsort(found, kind="stable")
            bits = np.zeros(1 << min(24, max(10, (16 * len(at)).bit_length())), dtype=bool)
            bits[(found & np.uint64(len(bits) - 1)).astype(np.int64)] = True
            self.sizes[size] = found[order], at[order], bits

    def gram(self, at: int, size: int) -> bytes:
        return self.text[self.first[at]: self.last[at + size - 1]]


def cover(words: W.Words, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which words lie in one of the windows."""
    edge = np.zeros(len(words.start) + 1, dtype=np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + size, -1)
    return np.cumsum(edge[:-1]) > 0


def scan(words: W.Words, grams: GramSet) -> tuple[np.ndarray, list[set[str]]]:
    """(words inside a hit, items found by row)."""
    hashes = words.hashes()
    starts, sizes, items = [], [], [set() for _ in range(words.n_rows)]
    text = first = last = None
    for size, (known, places, bits) in grams.sizes.items():
        at, found = W.windows(hashes, words.row, size)
        maybe = np.flatnonzero(bits[(found & np.uint64(len(bits) - 1)).astype(np.int64)])
        low, high = np.searchsorted(known, found[maybe]), np.searchsorted(known, found[maybe], side="right")
        hits = np.flatnonzero(low < high)
        if len(hits) and text is None:
            text, first, last = joined(words)
        for i, a, b in zip(at[maybe[hits]].tolist(), low[hits].tolist(), high[hits].tolist(), strict=True):
            own = text[first[i]: last[i + size - 1]]
            owners = {grams.items[grams.item[p]] for p in places[a:b].tolist() if grams.gram(p, size) == own}
            if owners:
                starts.append(i)
                sizes.append(size)
                items[words.row[i]] |= owners
    return cover(words, np.array(starts, dtype=np.int64), np.array(sizes, dtype=np.int64)), items


def runs(hit: np.ndarray, words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) of the runs of hit words inside each row."""
    at = np.flatnonzero(hit)
    if not len(at):
        return at, at
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (np.diff(at) > 1) | (np.diff(words.row[at]) > 0)
    return at[fresh], at[np.append(np.flatnonzero(fresh)[1:], len(at)) - 1] + 1


def _scan_rows(grams, keep: list[str], schema: pa.Schema):
    def run(batches):
        known = grams.value
        for rows, data, bounds in W.slices(batches):
            words = W.split(data, bounds, W.ALNUM, lower=True)
            hit, items = scan(words, known)
            first = words.first()
            spans: list[list] = [[] for _ in range(words.n_rows)]
            for a, b in zip(*runs(hit, words), strict=True):
                r = words.row[a]
                spans[r].append({"start": int(a - first[r]), "end": int(b - first[r])})
            yield pa.RecordBatch.from_arrays(
                [W.column(rows, c) for c in keep]
                + [pa.array(np.diff(first)), pa.array(np.bincount(words.row[hit], minlength=words.n_rows)),
                   pa.array([sorted(x - {None}) for x in items], schema.field("items").type),
                   pa.array(spans, schema.field("spans").type)],
                names=[*keep, "n_words", "n_hit", "items", "spans"])
    return run


def _broadcast_set(benchmark: DataFrame, n: int, item_id: str, text: str, max_grams: int):
    """The windows as a broadcast set, or None where they exceed the bounds."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).where(F.col("text") != "")
    total = items.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0)))).first()[0] or 0
    if total > MAX_BYTES or not is_small(benchmark_grams(benchmark, n, item_id, text), max_grams):
        return None
    return benchmark.sparkSession.sparkContext.broadcast(GramSet([tuple(r) for r in items.collect()], n))


def _bit_table(grams: DataFrame) -> np.ndarray:
    """BIT_WORDS words in which the bit of every window's hash is set."""
    rows = grams.groupBy(F.expr(f"shiftright(hash, 6) & {BIT_WORDS - 1}L").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(hash & 63L as int))")).alias("bits")).toPandas()
    table = np.zeros(BIT_WORDS, dtype=np.uint64)
    table[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return table


def _candidate_rows(bits, sizes: list[int]):
    def run(batches):
        table = bits.value
        for rows, data, bounds in W.slices(batches):
            words = W.split(data, bounds, W.ALNUM, lower=True)
            first, hashes = words.first(), words.hashes()
            keys = W.column(rows, "row_key")
            for size in sizes:
                at, found = W.windows(hashes, words.row, size)
                place = ((found >> np.uint64(6)) & np.uint64(BIT_WORDS - 1)).astype(np.int64)
                maybe = np.flatnonzero((table[place] >> (found & np.uint64(63))) & np.uint64(1))
                at, found = at[maybe], found[maybe]
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(words.row[at])), pa.array((at - first[words.row[at]]).astype(np.int32)),
                     pa.array(np.full(len(at), size, dtype=np.int32)), pa.array(W.signed(found))],
                    names=["row_key", "at", "size", "hash"])
    return run


def _hit_texts(batches):
    for rows, data, bounds in W.slices(batches):
        words = W.split(data, bounds, W.ALNUM, lower=True)
        start, (text, first, last) = words.first(), joined(words)
        keys, found = W.column(rows, "row_key").to_pylist(), W.column(rows, "found").to_pylist()
        out = [(keys[r], h["at"], h["size"], h["hash"], text[first[i]: last[i + h["size"] - 1]].decode("utf-8", "replace"))
               for r in range(words.n_rows) for h in found[r] for i in (start[r] + h["at"],)]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(
            (pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.string()))], names=["row_key", "at", "size", "hash", "gram"])


def _text_key(text: str) -> Column:
    """Equal texts share it and have the same result."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def _joined_hits(texts: DataFrame, grams: DataFrame) -> DataFrame:
    """``row_key, at, size, item`` of the verified hits of ``texts`` (``row_key, text``)."""
    sizes = sorted(r["size"] for r in grams.select("size").distinct().collect())  # at most n
    bits = texts.sparkSession.sparkContext.broadcast(_bit_table(grams))
    hits = (texts.mapInArrow(_candidate_rows(bits, sizes), "row_key binary, at int, size int, hash bigint")
            .join(grams.select("size", "hash").distinct(), ["size", "hash"], "left_semi")
            .groupBy("row_key").agg(F.collect_set(F.struct("at", "size", "hash")).alias("found")))
    return (texts.join(hits, "row_key").select("row_key", "text", "found")
            .mapInArrow(_hit_texts, "row_key binary, at int, size int, hash bigint, gram string").distinct()
            .join(grams, ["size", "hash", "gram"]).select("row_key", "at", "size", "item"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", max_grams: int = MAX_GRAMS) -> DataFrame:
    """Per document: ``n_words, n_hit, items`` (sorted strings) and the hit ``spans`` as word ranges."""
    rows = bounded(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    known = _broadcast_set(benchmark, n, item_id, "text", max_grams)
    if known is not None:
        arrow = pa.schema([("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        return rows.mapInArrow(_scan_rows(known, ["doc_id"], arrow), f"doc_id {kind}, {_HITS}")
    keyed = rows.withColumn("row_key", _text_key("text"))
    hits = _joined_hits(keyed.select("row_key", "text"), benchmark_grams(benchmark, n, item_id, "text")).groupBy("row_key").agg(
        F.sort_array(F.collect_set("item")).alias("items"),
        F.sort_array(F.collect_set(F.struct(F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("end")))).alias("raw"))
    merged = F.aggregate(
        "raw", F.array().cast(_SPANS),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))))
        ).otherwise(F.concat(done, F.array(x))))
    none = F.array().cast(_SPANS)
    counted = keyed.mapInArrow(_count_rows, f"doc_id {kind}, row_key binary, n_words bigint")
    return (counted.join(hits.withColumn("spans", merged).drop("raw"), "row_key", "left")
            .select("doc_id", "n_words",
                    F.aggregate(F.coalesce("spans", none), F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"]).alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", none).alias("spans")))


def _count_rows(batches):
    for rows, data, bounds in W.slices(batches):
        counts = W.split(data, bounds, W.ALNUM, lower=True).counts()
        yield pa.RecordBatch.from_arrays([W.column(rows, "doc_id"), W.column(rows, "row_key"), pa.array(counts)],
                                         names=["doc_id", "row_key", "n_words"])


def is_contaminated(n_words, n_hit):
    """At least one hit word in twenty."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def _cut(rows: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray, cuts: dict[int, list], text: str) -> pa.RecordBatch:
    """``rows`` without the byte ranges ``cuts`` of their texts."""
    kept, texts = data.tobytes(), W.column(rows, text).to_pylist()
    for r, gone in cuts.items():
        edges = [bounds[r], *(x for cut in gone for x in cut), bounds[r + 1]]
        texts[r] = b"".join(kept[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode("utf-8", "replace")
    at = rows.schema.get_field_index(text)
    return rows.set_column(at, rows.schema.field(at), pa.array(texts, rows.schema.field(at).type))


def _clean_rows(grams, spans: bool, text: str):
    def run(batches):
        known = grams.value
        for rows, data, bounds in W.slices(batches, text):
            words = W.split(data, bounds, W.ALNUM, lower=True)
            hit, _ = scan(words, known)
            if not spans:
                n_hit = np.bincount(words.row[hit], minlength=words.n_rows)
                yield rows.filter(pa.array(~((n_hit > 0) & (20 * n_hit >= words.counts()))))
                continue
            cuts = defaultdict(list)
            for a, b in zip(*runs(hit, words), strict=True):
                cuts[words.row[a]].append((words.start[a], words.end[b - 1]))
            yield _cut(rows, data, bounds, cuts, text)
    return run


def _cut_rows(columns: list[str], text: str, spans: str):
    def run(batches):
        for rows, data, bounds in W.slices(batches, text):
            words = W.split(data, bounds, W.ALNUM, lower=True)
            first, cuts = words.first(), {}
            for r, found in enumerate(W.column(rows, spans).to_pylist()):
                if found:
                    cuts[r] = [(words.start[first[r] + x["start"]], words.end[first[r] + x["end"] - 1]) for x in found]
            yield _cut(rows.select(columns), data, bounds, cuts, text)
    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = N_WORDS, text: str = "text",
                  item_id: str = "item_id", max_grams: int = MAX_GRAMS) -> DataFrame:
    """``docs`` without its contaminated documents, or with the hit spans cut out (``remove="spans"``).

    All columns pass through; only ``text`` changes, and only in the second mode.
    """
    known = _broadcast_set(benchmark, n, item_id, "text", max_grams)
    if known is not None:
        return bounded(docs).mapInArrow(_clean_rows(known, remove == "spans", text), docs.schema)
    key, of, spans = fresh(docs.columns, "text_key", "key_of", "hit_spans")
    keyed = docs.withColumn(key, _text_key(text))
    found = contamination(keyed.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), benchmark, n, item_id=item_id,
                          max_grams=max_grams).where("n_hit > 0").select(F.col("doc_id").alias(of), "n_words", "n_hit", F.col("spans").alias(spans))
    if remove != "spans":
        bad = found.where(is_contaminated(F.col("n_words"), F.col("n_hit"))).select(of).distinct()
        return keyed.join(bad, keyed[key] == bad[of], "left_anti").drop(key)
    cuts = found.select(of, spans).dropDuplicates([of])
    rows = keyed.join(cuts, keyed[key] == cuts[of], "left").select(*[keyed[c] for c in docs.columns], spans)
    return rows.mapInArrow(_cut_rows(docs.columns, text, spans), docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The result of ``contamination`` as counts and a hash of the items."""
    return found.select(
        "doc_id", F.col("n_words").cast("bigint").alias("n_words"), F.col("n_hit").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))


