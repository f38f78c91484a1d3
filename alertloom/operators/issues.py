"""Issue records: signatures, ids, cleaning, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom import config
from alertloom.functions.matching import words


def signature(severity: Column, title: Column, summary: Column) -> Column:
    """16 hex digits over severity, first five title and ten summary words."""
    first = lambda text, n: F.array_join(F.slice(words(F.lower(text)), 1, n), " ")
    joined = F.concat_ws("|", F.lower(severity), first(title, 5), first(summary, 10))
    return F.substring(F.sha2(joined, 256), 1, 16)


def issue_id(title: Column) -> Column:
    return F.substring(F.sha2(title, 256), 1, 10)


def comprehensive_id(title: Column, epoch_seconds: Column) -> Column:
    return F.concat(F.lit("comp_"), F.substring(F.md5(title), 1, 8), F.lit("_"), epoch_seconds.cast("string"))


def clean_related(refs: Column) -> Column:
    """Log references from a JSON array of strings or of objects with a hash."""
    items = F.from_json(refs, "array<string>")
    value = lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.sha256")).otherwise(
        F.when(F.length(x) >= 8, x))
    return F.filter(F.transform(items, value), lambda v: v.isNotNull())


def valid_minimal(issues: DataFrame) -> DataFrame:
    """Issues that have a title and a severity, other fields filled."""
    return issues.where((F.col("title") != "") & (F.col("severity") != "")).select(
        "raw_id", "title", F.lower("severity").alias("severity"),
        F.coalesce("summary", F.lit("No summary available")).alias("summary"),
        F.coalesce("category", F.lit("operational")).alias("category"),
        F.coalesce("recommendation", F.lit("")).alias("recommendation"),
    )


def valid_complete(issues: DataFrame) -> DataFrame:
    """Issues that carry all four required fields; the category defaults to security."""
    required = ["severity", "title", "summary", "recommendation"]
    return issues.dropna(subset=required).withColumn("category", F.coalesce("category", F.lit("security")))


def new_issues(detected: DataFrame, existing: DataFrame, ignored: DataFrame) -> DataFrame:
    """Detected issues that are neither known by signature or id, nor ignored.

    Of several detected issues with one signature the first is kept, and then
    the first per id. ``detected`` needs an ``ord`` column.
    """
    d = detected.withColumn("signature", signature(F.col("severity"), F.col("title"), F.col("summary")))
    d = d.withColumn("issue_id", issue_id(F.col("title")))
    known = existing.select(signature(F.col("severity"), F.col("title"), F.col("summary")).alias("signature")).distinct()
    d = d.join(known, "signature", "left_anti").join(ignored.select("issue_id").distinct(), "issue_id", "left_anti")
    columns = d.columns
    for key in ("signature", "issue_id"):  # a partial aggregate, so that a frequent issue is a row per task
        d = d.groupBy(key).agg(F.min_by(F.struct(*columns), "ord").alias("first")).select("first.*")
    return d.join(existing.select("issue_id").distinct(), "issue_id", "left_anti")


def merge_issues(fresh: DataFrame, existing: DataFrame, cap: int | None = None) -> DataFrame:
    """New issues in front of the known ones, all of them or, newest first, at most ``cap``."""
    columns = ["issue_id", "ts", "severity", "title", "summary", "category"]
    merged = fresh.select(*columns).unionByName(existing.select(*columns))
    return merged if cap is None else merged.orderBy(F.col("ts").desc(), F.col("issue_id")).limit(cap)


def ignore(issues: DataFrame, ignored: DataFrame) -> DataFrame:
    """Issues without the ignored ids."""
    return issues.join(ignored.select("issue_id").distinct(), "issue_id", "left_anti")


def detect_from_alerts(alerts: DataFrame, refs: int = 12) -> DataFrame:
    """One issue per rule and host with its newest log references.

    The counts come from one partial aggregation. The references are ranked per
    group with a limit, which Spark applies before the shuffle, so a group that
    holds a large part of all alerts moves at most ``refs`` rows per task.
    """
    keys = ["rule_desc", "agent_name"]
    stats = alerts.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max("rule_level").alias("max_level"),
        F.avg("rule_level").alias("mean_level"), F.max("ts").alias("ts"))
    newest = Window.partitionBy(*keys).orderBy(F.col("ts").desc(), F.col("alert_id").desc())
    related = (alerts.select(*keys, "ts", "alert_id", "sha256").withColumn("pos", F.row_number().over(newest))
               .where(F.col("pos") <= refs).groupBy(*keys)
               .agg(F.sort_array(F.collect_list(F.struct("pos", "sha256"))).alias("refs")))
    title = F.concat("rule_desc", F.lit(" activity on "), "agent_name")
    hot = F.col("mean_level") >= 4
    severity = (F.when((F.col("rule_desc") == "error") & hot, "Critical").when(F.col("rule_desc") == "error", "High")
                .when(hot, "Medium").otherwise("Low"))
    return stats.join(related, keys).select(
        issue_id(title).alias("issue_id"), title.alias("title"), severity.alias("severity"), "ts", "n",
        F.concat("n", F.lit(" events of "), "rule_desc", F.lit(" on "), "agent_name", F.lit(" up to level "),
                 "max_level").alias("summary"),
        F.concat(F.lit("Review "), "agent_name").alias("recommendation"),
        F.when(F.col("rule_desc").isin("error", "signup"), "security").otherwise("operational").alias("category"),
        "rule_desc", "agent_name",
        F.transform("refs", lambda r: r["sha256"]).alias("related_logs"),
    )
