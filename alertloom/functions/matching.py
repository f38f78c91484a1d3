"""Regular expression matches with character offsets, without a UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains_any(text: Column, words: list[str]) -> Column:
    """True when ``text`` contains one of ``words`` (plain substrings)."""
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def find_all(text: Column, pattern: str) -> Column:
    """Every match of ``pattern`` as ``array<struct<start,len,value>>``.

    ``start`` is a 0-based character offset. The pieces between matches and the
    matches themselves alternate, so a running sum of their lengths gives each
    offset; both come from built-in functions and stay in the JVM.
    """
    pieces = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:int,len:int,value:string>>")
    walk = F.aggregate(
        F.arrays_zip(pieces.alias("gap"), values.alias("val")),
        F.struct(F.lit(0).alias("pos"), empty.alias("hits")),
        lambda acc, x: F.struct(
            (acc["pos"] + F.length(x["gap"]) + F.coalesce(F.length(x["val"]), F.lit(0))).alias("pos"),
            F.when(x["val"].isNull(), acc["hits"]).otherwise(
                F.array_append(
                    acc["hits"],
                    F.struct(
                        (acc["pos"] + F.length(x["gap"])).alias("start"),
                        F.length(x["val"]).alias("len"),
                        x["val"].alias("value"),
                    ),
                )
            ).alias("hits"),
        ),
        lambda acc: acc["hits"],
    )
    # Most texts match few of the patterns; the walk is skipped for the others.
    return F.when(text.rlike(pattern), walk).otherwise(empty)


def context_of(text: Column, hit: Column, width: int) -> Column:
    """The match with ``width`` characters on both sides, clipped to the text."""
    first = F.greatest(hit["start"] - width, F.lit(0))
    return F.substring(text, first + 1, hit["start"] + hit["len"] + width - first)


def tokens(text: Column) -> Column:
    """Keyword tokens: lower case, split at white space and ``, . :``."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[^\s,.:]+"), F.lit(0))


def words(text: Column) -> Column:
    """White-space words without empty strings."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def exploded(df: DataFrame, keep: list, array: Column, name: str) -> DataFrame:
    """One row per element of a computed array.

    A plain explode makes the optimizer add ``size(array) > 0`` as a filter and
    push it towards the scan, so an expensive array is computed twice, possibly
    on far more rows. The outer form computes it once; its empty rows are
    dropped afterwards.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())
