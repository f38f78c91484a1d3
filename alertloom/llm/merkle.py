"""Merkle fingerprints of documents: pieces, paragraphs, sections, root.

A text is cut at blank lines into sections, at line ends into paragraphs, and
every paragraph into pieces that end at a sentence mark or after PIECE code
points. A piece is hashed by content, a paragraph by its pieces, a section by
its paragraphs, the root by its sections. Equal roots mean equal texts; where
roots differ, equal sections and paragraphs are passed over and the differing
ones locate the edit. The likeness of two trees is the share of distinct leaves
they have in common (2 * common / (a + b); 1 for equal roots).

Only built-in functions are used. Null counts as the empty text, whose tree is
one empty paragraph. Repeated rows have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.session import cut_lineage

PIECE = 32
_PIECES = r"[^.!?]{1,%d}[.!?]*|[.!?]+" % PIECE
LEAF_HEX = 16
#: rows in one range of ids, and the most ranges
RANGE_ROWS, MAX_RANGES = 2000, 20_000


def leaves(text: Column) -> Column:
    """array<section: array<paragraph: array<leaf hash>>>"""
    return F.transform(F.split(text, "\n\n", -1), lambda section: F.transform(
        F.split(section, "\n", -1), lambda paragraph: F.transform(
            F.regexp_extract_all(paragraph, F.lit(_PIECES), F.lit(0)), lambda piece: F.substring(F.sha2(piece, 256), 1, LEAF_HEX))))


def paragraphs(tree: Column) -> Column:
    """array<section: array<paragraph hash>>"""
    return F.transform(tree, lambda s: F.transform(s, lambda p: F.sha2(F.array_join(p, ","), 256)))


def sections(hashed: Column) -> Column:
    return F.transform(hashed, lambda s: F.sha2(F.array_join(s, ","), 256))


def root(hashed_sections: Column) -> Column:
    return F.sha2(F.array_join(hashed_sections, ","), 256)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, sections, paragraphs, leaves`` of every document."""
    return (docs.select(F.col(doc_id).alias("doc_id"), leaves(F.coalesce(F.col(text), F.lit(""))).alias("leaves"))
            .withColumn("paragraphs", paragraphs(F.col("leaves"))).withColumn("sections", sections(F.col("paragraphs")))
            .select("doc_id", root(F.col("sections")).alias("fingerprint"), "sections", "paragraphs", "leaves"))


def likeness(root_a: Column, leaves_a: Column, root_b: Column, leaves_b: Column) -> Column:
    """Of two trees; the leaves as flat distinct arrays."""
    both = F.size(leaves_a) + F.size(leaves_b)
    return (F.when(root_a == root_b, F.lit(1.0)).when(both == 0, F.lit(0.0))
            .otherwise(2.0 * F.size(F.array_intersect(leaves_a, leaves_b)) / both))


def differing(a: Column, b: Column) -> Column:
    """Positions (from 0) at which two lists of hashes differ, those beyond the shorter one included."""
    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)))


def _ranges(ids: DataFrame, range_rows: int, max_ranges: int):
    """An expression from id to its range, ranges numbered upwards; null ids are range 0.

    At most ``max_ranges`` bounds come to the driver, as a list of lists, so
    that a row is compared with about 2 * sqrt(max_ranges) of them.
    """
    wanted = max(1, min(max_ranges, -(-ids.count() // range_rows)))
    shares = [i / wanted for i in range(1, wanted)]
    bounds = []
    if shares:
        found = ids.agg(F.percentile_approx("doc_id", shares, 10 * wanted).alias("b")).first()["b"] or []
        bounds = sorted(set(found))
    if not bounds:
        return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.lit(1))
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i: i + step] for i in range(0, len(bounds), step)]
    kind = ids.schema["doc_id"].dataType.simpleString()
    heads = F.array(*[F.lit(g[0]).cast(kind) for g in groups])
    inner = F.array(*[F.array(*[F.lit(x).cast(kind) for x in g]) for g in groups])
    group = F.greatest(F.size(F.filter(heads, lambda x: x <= F.col("doc_id"))), F.lit(1))
    place = (group - 1) * step + F.size(F.filter(F.get(inner, group - 1), lambda x: x <= F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(place + 1)


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS, max_ranges: int = MAX_RANGES) -> DataFrame:
    """``doc_id, text, next_text``: the next document in descending id, after the last one the first.

    Rows of equal id follow each other by the hash of their texts; null ids come
    last. Ids are cut into ranges of about equal numbers of rows, and each range
    is ordered by itself; the first row of the next range below is added to a
    range as its tail, so texts are shuffled once.
    """
    ranged = docs.withColumn("range", _ranges(docs.select("doc_id"), range_rows, max_ranges)).withColumn("tie", F.xxhash64("text"))
    heads = ranged.groupBy("range").agg(F.max("doc_id").alias("head"))
    ties = ranged.select("range", "doc_id", "tie").join(F.broadcast(heads), "range").where(F.col("doc_id").eqNullSafe(F.col("head")))
    order = Window.orderBy(F.col("range").desc())  # at most max_ranges rows
    first = cut_lineage(ties.groupBy("range", "head").agg(F.max("tie").alias("tie")), "heads")
    tails = (first.withColumn("for_range", F.coalesce(F.lag("range").over(order), F.min("range").over(Window.partitionBy())))
             .select(F.col("range").alias("r"), F.col("head"), F.col("tie").alias("t"), "for_range"))
    extra = (ranged.join(F.broadcast(tails), (F.col("range") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("tie") == F.col("t")))
             .select("for_range", "doc_id", "text", "tie").dropDuplicates(["for_range"]))
    rows = ranged.select("range", "doc_id", "text", "tie", F.lit(False).alias("tail")).unionByName(
        extra.select(F.col("for_range").alias("range"), "doc_id", "text", "tie", F.lit(True).alias("tail")))
    down = Window.partitionBy("range").orderBy("tail", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    return rows.withColumn("next_text", F.lead("text").over(down)).where(~F.col("tail")).select("doc_id", "text", "next_text")


def compare_with_edit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of every text and of its edit by the next document, and their likeness.

    The edit replaces the last third (rounded down) by the start of the next
    document. ``changed_from`` is the first paragraph that differs, null if none.
    """
    rows = with_next(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")), range_rows)
    n = F.length("text")
    edited = F.concat(F.expr("left(text, length(text) - int(floor(length(text) / 3)))"), F.expr("left(next_text, int(floor(length(text) / 3)))"))
    rows = rows.withColumn("edited", edited)
    for name in ("text", "edited", "next_text"):
        rows = rows.withColumn(f"{name}_tree", leaves(F.col(name)))
    for name in ("text", "edited", "next_text"):
        tree = F.col(f"{name}_tree")
        rows = (rows.withColumn(f"{name}_paragraphs", paragraphs(tree))
                .withColumn(f"{name}_leaves", F.array_distinct(F.flatten(F.flatten(tree)))))
    for name in ("text", "edited", "next_text"):
        rows = rows.withColumn(f"{name}_root", root(sections(F.col(f"{name}_paragraphs"))))
    changed = differing(F.flatten("text_paragraphs"), F.flatten("edited_paragraphs"))
    return rows.select(
        "doc_id", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.col("text_root").alias("fingerprint"), F.col("edited_root").alias("edited_fingerprint"),
        likeness(F.col("text_root"), F.col("text_leaves"), F.col("edited_root"), F.col("edited_leaves")).alias("near_edited"),
        likeness(F.col("text_root"), F.col("text_leaves"), F.col("next_text_root"), F.col("next_text_leaves")).alias("near_next"),
        F.get(changed, F.lit(0)).cast("bigint").alias("changed_from"))
