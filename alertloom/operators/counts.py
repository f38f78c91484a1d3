"""Dashboard counts and small summary statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom import config
from alertloom.session import cut_lineage


def log_trend(logs: DataFrame, buckets: int = config.TREND_BUCKETS, ts: str = "ts") -> DataFrame:
    """Alerts per minute, newest ``buckets`` minutes."""
    return (logs.groupBy(F.date_trunc("minute", ts).alias("minute")).agg(F.count("*").alias("n"))
            .orderBy(F.col("minute").desc()).limit(buckets))


def rule_distribution(logs: DataFrame, description: str = "rule_desc", top: int = config.RULE_CHART_SIZE) -> DataFrame:
    """Most frequent rules with a chart label of at most 30 characters."""
    rule = F.coalesce(F.col(description), F.lit("Unknown Rule"))
    label = F.when(F.length("rule") > 30, F.concat(F.substring("rule", 1, 27), F.lit("..."))).otherwise(F.col("rule"))
    return (logs.groupBy(rule.alias("rule")).agg(F.count("*").alias("n"))
            .orderBy(F.col("n").desc(), "rule").limit(top).withColumn("label", label))


def level_counts(logs: DataFrame, level: str = "rule_level") -> DataFrame:
    return (logs.groupBy(F.coalesce(F.col(level).cast("string"), F.lit("unknown")).alias("level"))
            .agg(F.count("*").alias("n")))


def entity_frequency(mentions: DataFrame, top: int | None = 10) -> DataFrame:
    """Logs per entity from ``(sha256, entity)`` rows that are distinct per log."""
    counted = mentions.groupBy("entity").agg(F.count("*").alias("logs"))
    return counted if top is None else counted.orderBy(F.col("logs").desc(), "entity").limit(top)


def dashboard_stats(new_logs: DataFrame, all_logs: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: new logs, total logs, open anomalies."""
    parts = (new_logs.select(F.lit("new_logs").alias("stat"))
             .unionByName(all_logs.select(F.lit("total_logs").alias("stat")))
             .unionByName(issues.select(F.lit("anomalies").alias("stat"))))
    one = lambda name: F.count_if(F.col("stat") == name).alias(name)
    return parts.agg(one("new_logs"), one("total_logs"), one("anomalies"))


def merge_snapshots(old: DataFrame, new: DataFrame, key: str, value: str = "n") -> DataFrame:
    """Merge two aggregate tables by adding up their counters."""
    return old.unionByName(new).groupBy(key).agg(F.sum(value).alias(value))


def token_estimate(text: Column) -> Column:
    """Rough model tokens: bytes / 3 for JSON-like text, bytes / 4 otherwise."""
    head = F.substring(text, 1, 100)
    jsonish = F.ltrim(text).startswith("{") | head.contains('"')
    size = F.octet_length(text)
    return F.greatest(F.lit(1), F.floor(size / F.when(jsonish, 3).otherwise(4))).cast("bigint")


def token_reduction(before: Column, after: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - after / before))


def exact_median(rows: DataFrame, by: list[str], measure: str) -> DataFrame:
    """Exact median per group without holding a group's values in one task.

    Equal values are counted first. The counts are range-partitioned by group
    and value and summed range by range, so the middle of each group is found
    from the sizes of the ranges before it.
    """
    counted = rows.where(F.col(measure).isNotNull()).groupBy(*by, measure).agg(F.count("*").alias("c"))
    parted = cut_lineage(counted.repartitionByRange(*by, measure).withColumn("pid", F.spark_partition_id()), "median")
    ranges = parted.groupBy(*by, "pid").agg(F.sum("c").alias("size"))  # one row per group and range
    ahead = Window.partitionBy(*by).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.select(*by, "pid", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("before"),
                           F.sum("size").over(Window.partitionBy(*by)).alias("total"))
    running = F.sum("c").over(Window.partitionBy("pid", *by).orderBy(measure))
    upto = parted.withColumn("within", running).join(placed, [*by, "pid"]).withColumn("upto", F.col("before") + F.col("within"))
    covers = lambda at: (F.col("upto") >= at) & (F.col("upto") - F.col("c") < at)
    low, high = F.floor((F.col("total") + 1) / 2), F.ceil((F.col("total") + 1) / 2)
    pick = lambda at: F.max(F.when(covers(at), F.col(measure)))
    return upto.groupBy(*by).agg(((pick(low) + pick(high)) / 2).alias(f"{measure}_median"))


def latency_summary(calls: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """Count, mean, median, max and min of each measure."""
    aggs = [F.count("*").alias("calls")]
    for m in measures:
        aggs += [F.round(F.avg(m), 6).alias(f"{m}_mean"), F.max(m).alias(f"{m}_max"), F.min(m).alias(f"{m}_min")]
    out = calls.groupBy(*by).agg(*aggs)
    for m in measures:
        out = out.join(exact_median(calls, by, m), by).withColumn(f"{m}_median", F.round(f"{m}_median", 6))
    return out


def usage_metrics(calls: DataFrame) -> DataFrame:
    """Requests, throttled calls and tokens per model, one column per direction."""
    return calls.groupBy("model").agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("throttled")).alias("throttled"),
        F.sum(F.when(F.col("direction") == "input", F.col("tokens")).otherwise(0)).alias("input_tokens"),
        F.sum(F.when(F.col("direction") == "output", F.col("tokens")).otherwise(0)).alias("output_tokens"),
    )


def storage_stats(summaries: DataFrame) -> DataFrame:
    """Count, bytes and mean quality per level, with one total row."""
    return summaries.rollup("level").agg(
        F.count("*").alias("summaries"), F.sum("bytes").alias("bytes"),
        F.round(F.avg("quality"), 6).alias("mean_quality"),
    ).withColumn("level", F.coalesce("level", F.lit("total")))
