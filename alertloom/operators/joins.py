"""Set operations and lookups that relate two data sets.

No broadcast hints: Spark compares the size of a side with
``spark.sql.autoBroadcastJoinThreshold`` from statistics and again at run time,
and falls back to a shuffled join with skew splitting beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.functions import pii
from alertloom.functions.matching import exploded
from alertloom.operators import lookup


def hits_to_logs(hits: DataFrame, logs: DataFrame, key: str = "alert_id") -> DataFrame:
    return hits.join(logs, key)


def issue_related_logs(issues: DataFrame, logs: DataFrame, first: int = 10) -> DataFrame:
    """Logs an issue refers to, in reference order; absent logs drop out."""
    refs = issues.select("issue_id", F.posexplode(F.slice("related_logs", 1, first)).alias("pos", "sha256"))
    return refs.join(logs, "sha256")


def unseen_logs(hits: DataFrame, recent: DataFrame, cap: int, order: list[Column]) -> DataFrame:
    """Hits that are not among the recent logs, best ``cap``."""
    return hits.join(recent.select("sha256").distinct(), "sha256", "left_anti").orderBy(*order).limit(cap)


def entity_mentions(logs: DataFrame, known: DataFrame, entities: Column, key: str) -> DataFrame:
    """Known entities per log, by extraction and an equality join on the value.

    A containment join would compare every log with every entity. Extracting
    first turns it into a hash join whose size is the number of mentions.
    """
    found = exploded(logs, [key], entities, "value").withColumn("lowered", F.lower("value"))
    wanted = known.select(F.lower("entity").alias("lowered"), F.col("entity")).distinct()
    return found.join(wanted, "lowered").select(key, "entity").distinct()


def ordered_union(parts: list[DataFrame], key: list[str], cap: int | None = None) -> DataFrame:
    """Union of ranked lists; of repeats the one in the earliest list is kept.

    Every part carries ``rank``; the result adds ``part`` and ``seq``.
    """
    tagged = None
    for i, part in enumerate(parts):
        part = part.withColumn("part", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    first = Window.partitionBy(*key).orderBy("part", "rank")
    one = tagged.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
    return one if cap is None else one.orderBy("part", "rank", *key).limit(cap)


def first_strategy_wins(hits: DataFrame) -> DataFrame:
    """A log found by several strategies keeps the first, per query.

    ``min_by`` over a partial aggregate: rows of a log that many strategies
    return are reduced before the shuffle.
    """
    rest = [c for c in hits.columns if c not in ("query_id", "alert_id")]
    best = hits.groupBy("query_id", "alert_id").agg(
        F.min(F.struct("strategy_index", "rank", *[c for c in rest if c not in ("strategy_index", "rank")])).alias("b"))
    return best.select("query_id", "alert_id", *[F.col(f"b.{c}").alias(c) for c in rest])


def dedup_logs(logs: DataFrame, stored: DataFrame, key: str = "sha256") -> DataFrame:
    """New distinct logs: repeats within the batch and stored logs removed."""
    return logs.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def in_period(children: DataFrame, parents: DataFrame, grain: str) -> DataFrame:
    """Child periods fully inside a parent period, by an equality join on the period.

    A week that crosses a month end belongs to the month of its Monday.
    """
    keyed = children.withColumn("parent_start", F.date_trunc(grain, "period_start").cast("date"))
    wanted = parents.select(F.col("period_start").alias("parent_start"), F.col("summary_id").alias("parent_id"))
    return keyed.join(wanted, "parent_start").drop("parent_start")


def threat_intel(indicators: DataFrame, intel: DataFrame) -> DataFrame:
    """Flag indicators that an intelligence table lists, by type and lower-cased value.

    Addresses may be listed by network, domains by a parent. Listed ones gain confidence;
    ``pii.keep_original`` takes the flag to keep them readable. The different values are
    looked up once.
    """
    found = lookup.listed_values(indicators, intel).select(
        F.col("kind").alias("listed_kind"), F.col("value").alias("listed_value"), F.lit(True).alias("listed"))
    same = (F.col("kind") == F.col("listed_kind")) & (F.lower("value") == F.col("listed_value"))
    joined = indicators.join(found, same, "left")
    flagged = F.coalesce("listed", F.lit(False))
    return joined.select(
        *[c for c in indicators.columns if c != "confidence"],
        pii.boosted(F.col("kind"), F.col("confidence"), flagged).alias("confidence"),
        flagged.alias("is_threat"),
    )


def closure(edges: DataFrame) -> DataFrame:
    """All (ancestor, descendant, depth) pairs of a hierarchy.

    ``edges`` are (parent, child). One equality join per level, so the work per
    round is the number of edges at that depth; a level is written out before
    the next one starts. The shortest depth of a pair is kept, so cycles end
    with the last new pair.
    """
    from alertloom.session import cut_lineage

    edges = edges.select("parent", "child").distinct()
    seen = edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).alias("depth"))
    frontier = seen
    step = edges.select(F.col("parent").alias("descendant"), F.col("child").alias("below"))
    depth = 1
    while True:
        depth += 1
        reached = (frontier.join(step, "descendant")
                   .select("ancestor", F.col("below").alias("descendant"), F.lit(depth).alias("depth")).distinct()
                   .join(seen.select("ancestor", "descendant"), ["ancestor", "descendant"], "left_anti"))
        frontier = cut_lineage(reached, "closure")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def citations(findings: DataFrame, evidence: DataFrame, relevance: float = 0.8) -> DataFrame:
    """One citation per evidence row that has a hash."""
    return (findings.join(evidence, "issue_id").where(F.col("sha256") != "")
            .select("issue_id", "sha256", F.concat(F.substring("full_log", 1, 200), F.lit("...")).alias("quote"),
                    F.lit(relevance).alias("relevance")))
