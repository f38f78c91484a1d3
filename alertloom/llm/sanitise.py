"""Personal data, and terms that give away whose data it is.

Base patterns find e-mail, ip, card and phone spans. Each found value is a
protected entity, and so is the group it belongs to: the domain of an address, the
first three parts of an ip, the first six digits of a card or phone number. Values often
stand in one document only; what recurs is the group. The words within REACH words
of an entity are its context; over the whole corpus Spark counts in how many
documents a term stands in the context of an entity, and in how many documents the
term occurs at all. A term discloses an entity when it names it often (``share`` =
P(entity | term)) and more often than chance can explain: the statistic G2 of the
four counts (both, term only, entity only, neither) reaches ``min_g2``, and the share
is above P(entity). An exclusive term reaches that for frequent entities and in
small tables too. Terms over both thresholds are spans of kind ``term``: those that
disclose a value with a share of ``remove_share`` or more are removed, others, and those
that disclose a group only, are generalised to a class word. ``bits`` = log2
P(entity | term) / P(entity) is given with them and judged only if ``min_bits`` is set.

Documents of equal text are one document in every count; a passage that stands in
different texts counts in each of them. Texts are told apart by 128-bit hash, and
only hashes travel: contexts are (term, entity, text) once each, and the corpus is
counted as (term, text) once each, for terms that stand near one entity in
``min_support`` documents or more. A term that more documents hold than its best entity
could account for is left out as soon as a part of the corpus shows it: first one text
in 64 is counted, then one in 8 for the terms left, at last all of them. So what is
counted follows the number of contexts, not that of words, and every share is exact.
The terms are handed to the tasks when their number is checked to lie below
``max_terms``; more of them are joined by term.

Terms are words with A-Z lower-cased, compared by 64-bit hash. The set of
disclosing terms is broadcast under the same bound; a larger one meets the texts in one join.

Null and empty texts have no spans. Repeated rows are judged each by itself.
Offsets are code points, ends exclusive. Extra columns of any name pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm import words as W
from alertloom.llm.batches import bounded, fresh
from alertloom.llm.toxicity import Lookup, distinct_pairs
from alertloom.session import cut_lineage, is_small, settled

KINDS = ("email", "ip", "card", "phone", "term")
LABELS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")
REACH = 8
MIN_SUPPORT = 3
MIN_SHARE, REMOVE_SHARE = 0.5, 0.8
#: chi-squared with one degree of freedom, p = 0.001
MIN_G2 = 10.83
MAX_TERMS = 500_000
#: one text in so many is counted, round by round; the last round counts all
PARTS = (64, 8, 1)
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits is entered at its start only: if that fails, so does every later digit of it
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @, domain; found from the @, so that long words stay cheap."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _is_octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_is_octet, m.group().split(".")))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def entity_names(kind: int, value: str) -> tuple[str, str]:
    """(value, group) of a span, in a form in which equal ones are equal."""
    if kind == 0:
        value = value.lower()
        return f"0:{value}", f"0:@{value.partition('@')[2]}"
    value = "".join(c for c in value if c.isdigit() or (kind == 1 and c == "."))
    return f"{kind}:{value}", f"{kind}:{value.rpartition('.')[0] if kind == 1 else value[:6]}*"


def _entity(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little", signed=True)


def _text_names(texts: list[str]) -> tuple[list[int], list[int]]:
    """Two 64-bit hashes of each text."""
    both = [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts]
    return tuple([int.from_bytes(x[i: i + 8], "little", signed=True) for x in both] for i in (0, 8))


def _byte_offsets(text: str, spans) -> list[tuple[int, int]]:
    """UTF-8 offsets of code point spans."""
    if text.isascii():
        return [(a, b) for _, a, b in spans]
    points = sorted({x for _, a, b in spans for x in (a, b)})
    at, done, out = 0, 0, {}
    for p in points:
        at += len(text[done:p].encode())
        done = p
        out[p] = at
    return [(out[a], out[b]) for _, a, b in spans]


_CONTEXT = "term bigint, entity bigint, broad boolean, t1 bigint, t2 bigint"


def _context_rows(reach: int):
    """(term, entity, whether it is a group, text) for every term near it, and the same with a null term for every entity of the text."""
    def run(batches):
        for rows, data, bounds in W.slices(batches):
            terms, entities, broad, own = [], [], [], []
            texts = W.column(rows, "text").to_pylist()
            for r, text in enumerate(texts):
                spans = base_spans(text) if text else []
                if not spans:
                    continue
                words = W.split(data[bounds[r]: bounds[r + 1]], np.array([0, bounds[r + 1] - bounds[r]]), W.ALNUM, lower=True)
                hashes = words.hashes()
                where = _byte_offsets(text, spans)
                free = np.ones(len(hashes), dtype=bool)
                around: dict[tuple[str, bool], list[np.ndarray]] = {}
                for a, b in where:
                    free[np.searchsorted(words.end, a, side="right"): np.searchsorted(words.start, b)] = False
                for (kind, a, b), (x, y) in zip(spans, where, strict=True):
                    low, high = np.searchsorted(words.end, x, side="right"), np.searchsorted(words.start, y)
                    near = np.r_[max(0, low - reach): low, high: min(len(hashes), high + reach)].astype(np.int64)
                    for group, name in enumerate(entity_names(kind, text[a:b])):
                        around.setdefault((name, bool(group)), []).append(hashes[near[free[near]]])
                for (name, group), found in around.items():
                    near = W.signed(np.unique(np.concatenate(found))).tolist()
                    terms += [*near, None]
                    entities += [_entity(name)] * (len(near) + 1)
                    broad += [group] * (len(near) + 1)
                    own += [r] * (len(near) + 1)
            names = dict(zip(some := sorted(set(own)), zip(*_text_names([texts[r] for r in some]), strict=True), strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.int64()), pa.array(entities, pa.int64()), pa.array(broad, pa.bool_()), *(pa.array([names[r][i] for r in own], pa.int64()) for i in (0, 1))],
                names=["term", "entity", "broad", "t1", "t2"])
    return run


def _text_rows(known):
    """(term, text) once for every text and each of its terms among ``known`` (None: all of its terms)."""
    def run(batches):
        lookup = known and Lookup(known.value)
        for rows, data, bounds in W.slices(batches):
            words = W.split(data, bounds, W.ALNUM, lower=True)
            hashes = words.hashes()
            if lookup:
                row, at = lookup.find(words.row, hashes)
                hashes = lookup.known[at]
            else:
                row, hashes = distinct_pairs(words.row, hashes)
            if len(row):
                texts = W.column(rows, "text").to_pylist()
                where, place = np.unique(row, return_inverse=True)
                names = _text_names([texts[r] or "" for r in where.tolist()])
                yield pa.RecordBatch.from_arrays([pa.array(W.signed(hashes)), *(pa.array(np.array(x, dtype=np.int64)[place]) for x in names)], names=["term", "t1", "t2"])
    return run


def _g2(both, term, entity, n) -> Column:
    """The log-likelihood ratio of a term and an entity being independent, from numbers of documents."""
    def part(seen, row, column):
        return F.when(seen > 0, seen * F.log(seen * n / (row * column))).otherwise(0.0)

    return 2 * (part(both, term, entity) + part(term - both, term, n - entity) + part(entity - both, n - term, entity)
                + part(n - term - entity + both, n - term, n - entity))


def disclosing_terms(docs: DataFrame, text: str = "text", reach: int = REACH, min_support: int = MIN_SUPPORT, min_share: float = MIN_SHARE,
                     remove_share: float = REMOVE_SHARE, min_bits: float | None = None, min_g2: float = MIN_G2, max_terms: int = MAX_TERMS) -> DataFrame:
    """``term`` (hash), ``level`` (1 generalise, 2 remove), ``share``, ``bits``, ``g2`` of the terms over the thresholds."""
    return settled(docs.sparkSession, "disclosing", lambda: _disclosing(docs, text, reach, min_support, min_share, remove_share, min_bits, min_g2, max_terms))


def _counted(texts: DataFrame, terms: DataFrame, part: int, max_terms: int) -> DataFrame:
    """``term, n_term``: different texts of one in ``part`` (by hash) that hold the term."""
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(part)) == 0) if part > 1 else texts
    if is_small(terms, max_terms):
        known = texts.sparkSession.sparkContext.broadcast(np.sort(terms.toArrow()["term"].to_numpy().view(np.uint64)))
        places = some.mapInArrow(_text_rows(known), "term bigint, t1 bigint, t2 bigint")
    else:
        places = some.mapInArrow(_text_rows(None), "term bigint, t1 bigint, t2 bigint").join(terms, "term", "left_semi")
    return places.distinct().groupBy("term").agg(F.count("*").alias("n_term"))


def _disclosing(docs: DataFrame, text: str, reach: int, min_support: int, min_share: float, remove_share: float, min_bits: float | None, min_g2: float, max_terms: int) -> DataFrame:
    texts = bounded(docs).select(F.col(text).alias("text")).where("text is not null")
    n_docs = texts.select(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")).distinct().count()
    near = texts.mapInArrow(_context_rows(reach), _CONTEXT).distinct().groupBy("term", "entity", "broad").agg(F.count("*").alias("n"))
    near = cut_lineage(near.where(f"term is null or n >= {int(min_support)}"), "contexts")
    pairs = near.where("term is not null").withColumnRenamed("n", "n_both")
    entities = near.where("term is null").select("entity", "broad", F.col("n").alias("n_entity"))
    corpus = cut_lineage(pairs.groupBy("term").agg(F.max("n_both").alias("most")), "context-terms")
    for part in PARTS:
        corpus = corpus.select("term", "most").join(_counted(texts, corpus.select("term"), part, max_terms), "term", "left").fillna(0, ["n_term"])
        corpus = cut_lineage(corpus.where(F.col("most") >= F.col("n_term") * min_share), "context-terms")
    share, n = F.col("n_both") / F.col("n_term"), F.lit(float(max(n_docs, 1)))
    chance = F.col("n_entity") / n
    judged = (pairs.join(entities, ["entity", "broad"]).join(corpus.drop("most"), "term")
              .withColumn("share", share).withColumn("bits", F.log2(share / chance))
              .withColumn("g2", _g2(*(F.col(c).cast("double") for c in ("n_both", "n_term", "n_entity")), n)))
    known_better = (F.col("share") > chance) & (F.col("g2") >= min_g2)
    if min_bits is not None:
        known_better &= F.col("bits") >= min_bits
    return (judged.where((F.col("share") >= min_share) & known_better).groupBy("term")
            .agg(F.max("share").alias("share"), F.max("bits").alias("bits"), F.max("g2").alias("g2"),
                 F.max(F.when(~F.col("broad") & (F.col("share") >= remove_share), 2).otherwise(1)).alias("level")))


class Terms:
    """Disclosing terms of a corpus, by hash."""

    def __init__(self, terms: list[tuple[int, int]]):
        both = sorted((t & ((1 << 64) - 1), level) for t, level in terms)
        self.lookup = Lookup(np.array([t for t, _ in both], dtype=np.uint64))
        self.level = [level for _, level in both]

    def spans(self, data, bounds, texts) -> list[list[tuple[int, int, int]]]:
        """(level, start, end) in code points, by row."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not self.level:
            return out
        words = W.split(data, bounds, W.ALNUM, lower=True)
        index, at = self.lookup.find(np.arange(len(words.row)), words.hashes())
        for i, level in zip(index.tolist(), at.tolist(), strict=True):
            r = words.row[i]
            a, b = words.start[i] - bounds[r], words.end[i] - bounds[r]
            if not texts[r].isascii():
                raw = texts[r].encode()
                a, b = len(raw[:a].decode()), len(raw[:b].decode())
            out[r].append((self.level[level], int(a), int(b)))
        return out


def all_spans(text: str, terms: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, level): the base spans and the terms outside them."""
    base = base_spans(text)
    covered = sorted((a, b) for _, a, b in base)
    out = [(kind, a, b, 0) for kind, a, b in base]
    i, reach = 0, 0
    for level, a, b in terms:
        while i < len(covered) and covered[i][0] < b:
            reach = max(reach, covered[i][1])
            i += 1
        if a >= reach:
            out.append((4, a, b, level))
    return out


def rewrite(text: str, spans: list[tuple[int, int, int, int]]) -> str:
    """Values become their kind, removed terms go, others become a class word. Overlaps are one span."""
    out, done = [], 0
    for kind, a, b, level in sorted(spans, key=lambda s: (s[1], s[0])):
        if a >= done:
            word = text[a:b]
            out += [text[done:a], LABELS[kind] if kind < 4 else "" if level == 2 else "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[TERM]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


_SPANS = "array<struct<kind:string,start:int,end:int,level:int>>"


def _apply(known, keep: list[str], text: str, rewritten: bool, own_terms: str = ""):
    """known: a broadcast Terms, or None when each row brings its own terms in the column ``own_terms``."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("level", pa.int32())]))

    def run(batches):
        for rows, data, bounds in W.slices(batches, text):
            column = W.column(rows, text)
            raw = column.to_pylist()
            texts = [t or "" for t in raw]
            if known is not None:
                terms = known.value.spans(data, bounds, texts)
            else:
                terms = [Terms([(x["term"], x["level"]) for x in own or ()]).spans(data[bounds[r]: bounds[r + 1]], bounds[r: r + 2] - bounds[r], [texts[r]])[0]
                         for r, own in enumerate(W.column(rows, own_terms).to_pylist())]
            found = [all_spans(t, more) for t, more in zip(texts, terms, strict=True)]
            arrays = [W.column(rows, c) for c in keep]
            if rewritten:
                new = [t if t is None or not s else rewrite(t, s) for t, s in zip(raw, found, strict=True)]
                arrays[keep.index(text)] = pa.array(new, column.type)
                yield pa.RecordBatch.from_arrays(arrays, names=keep)
            else:
                spans = [[{"kind": KINDS[k], "start": a, "end": b, "level": level} for k, a, b, level in s] for s in found]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(spans, kind)], names=[*keep, "spans"])
    return run


def _run(docs: DataFrame, terms: DataFrame, keep: list[str], text: str, rewritten: bool, schema, max_terms: int) -> DataFrame:
    terms = cut_lineage(terms.select("term", "level"), "terms")
    if is_small(terms, max_terms):
        known = docs.sparkSession.sparkContext.broadcast(Terms([(r["term"], r["level"]) for r in terms.collect()]))
        return bounded(docs).mapInArrow(_apply(known, keep, text, rewritten), schema)
    t1, t2, own_terms = fresh(docs.columns, "t1", "t2", "terms")
    names = [F.xxhash64(F.col(text)), F.xxhash64(F.lit(1), F.col(text))]
    own = (docs.select(names[0].alias("t1"), names[1].alias("t2"), F.col(text).alias("text")).where("text is not null").mapInArrow(_named_rows, "term bigint, t1 bigint, t2 bigint")
           .distinct().join(terms, "term").groupBy("t1", "t2").agg(F.collect_list(F.struct("term", "level")).alias(own_terms))
           .withColumnsRenamed({"t1": t1, "t2": t2}))
    rows = docs.withColumns({t1: names[0], t2: names[1]}).join(own, [t1, t2], "left").select(*docs.columns, own_terms)
    return bounded(rows).mapInArrow(_apply(None, keep, text, rewritten, own_terms), schema)


def _named_rows(batches):
    """(term, text) of texts that bring their names along."""
    for rows, data, bounds in W.slices(batches):
        words = W.split(data, bounds, W.ALNUM, lower=True)
        row, hashes = distinct_pairs(words.row, words.hashes())
        yield pa.RecordBatch.from_arrays([pa.array(W.signed(hashes)), *(W.column(rows, c).take(pa.array(row)) for c in ("t1", "t2"))], names=["term", "t1", "t2"])


def find(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text", max_terms: int = MAX_TERMS) -> DataFrame:
    """``doc_id, spans``: base spans by kind, then start, then the disclosing terms."""
    rows = bounded(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return _run(rows, terms, ["doc_id"], "text", False, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {_SPANS}", max_terms)


def sanitise(docs: DataFrame, terms: DataFrame, text: str = "text", max_terms: int = MAX_TERMS) -> DataFrame:
    """``docs`` with rewritten texts; all other columns pass through."""
    return _run(docs, terms, docs.columns, text, True, docs.schema, max_terms)


def digest(found: DataFrame) -> DataFrame:
    """The result of ``find`` as counts, a hash of the base spans, and all spans as one string."""
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select("doc_id", *map(count, KINDS[:4]), F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "term")), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))
