"""Connected components of an edge table, by alternating stars.

Each round hangs all larger neighbours of a node on the smallest node it knows
(large star), then all smaller ones (small star). Both are an aggregate by node
joined back to the edges, so a node with very many edges is pre-aggregated
before the shuffle and its rows can be split in the join. The number of edges
never grows, and rounds grow with the logarithm of the longest path. Every
round is written to the shared folder, which keeps the plan short and a lost
executor cheap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (v, u). Large: neighbours above a node go to its minimum. Small: those below."""
    both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u"))) if large else edges.select(
        F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u"))
    low = both.groupBy("v").agg(F.min("u").alias("low")).withColumn("low", F.least("v", "low"))
    met = both.join(low, "v")
    if large:
        out = met.where(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("low").alias("u"))
    else:
        out = met.select(F.col("u").alias("v"), F.col("low").alias("u")).unionByName(low.select("v", F.col("low").alias("u")))
    return out.where(F.col("v") != F.col("u")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node with an edge to another one; root is the smallest node of its component.

    Edges with a null end and loops are ignored; an empty table gives none.
    """
    now = cut_lineage(edges.select(F.col(a).alias("v"), F.col(b).alias("u")).where(F.col("v") != F.col("u")).distinct(), "links")

    def state(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()

    before = state(now)
    while before[0]:
        now = cut_lineage(_star(_star(now, True), False), "links")
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
        now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
