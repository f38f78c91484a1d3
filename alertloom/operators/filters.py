"""Projections, filters and row predicates over alert rows and issues."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.functions.matching import contains_any, words


def alert_text(*fields: Column) -> Column:
    """The search document of an alert: its fields as one JSON object."""
    return F.to_json(F.struct(*fields))


def cluster_text(description: Column, groups: Column, data: Column, full_log: Column,
                 max_value: int = 200, max_log: int = 500) -> Column:
    """Text an alert is embedded by: rule, groups, short data values, short raw log."""
    short = F.map_filter(data, lambda _, v: F.length(v) < max_value)
    pairs = F.transform(F.map_entries(short), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.concat_ws(" ", description, groups, pairs, F.when(F.length(full_log) < max_log, full_log))


def compact_log(hits: DataFrame) -> DataFrame:
    """Short form of a search hit for display next to an answer."""
    return hits.select(
        "query_id", "alert_id",
        F.substring("rule_desc", 1, 100).alias("rule"),
        F.substring("sha256", 1, 8).alias("sha"),
        F.substring("full_log", 1, 200).alias("data"),
        F.when(F.col("bm25_score") > 0, "hybrid").otherwise("comprehensive").alias("match_type"),
    )


def content_projection(logs: DataFrame, n: int = 50) -> DataFrame:
    """Key fields of the newest ``n`` rows."""
    return (logs.orderBy(F.col("ts").desc(), F.col("alert_id").desc()).limit(n)
            .select("alert_id", "rule_id", "rule_desc", "rule_level", "agent_name", "sha256"))


def evidence_projection(logs: DataFrame, n: int = 20, width: int = 500) -> DataFrame:
    """Evidence rows: reference, rule and the raw log cut to ``width`` characters."""
    return (logs.orderBy(F.col("ts").desc(), F.col("alert_id").desc()).limit(n)
            .select("alert_id", "sha256", "rule_desc", F.substring("full_log", 1, width).alias("excerpt")))


def logs_for_date(logs: DataFrame, day: str, ts: str = "ts") -> DataFrame:
    """Rows of one day; the half-open range prunes partitions and row groups."""
    first = dt.date.fromisoformat(day)
    after = first + dt.timedelta(days=1)
    kind = logs.schema[ts].dataType
    return logs.where((F.col(ts) >= F.lit(str(first)).cast(kind)) & (F.col(ts) < F.lit(str(after)).cast(kind)))


def trailing_window(logs: DataFrame, now: str, hours: int, ts_text: str = "timestamp") -> DataFrame:
    """Rows of the last ``hours``; rows whose time cannot be read are kept."""
    at = F.try_to_timestamp(F.col(ts_text))
    cutoff = dt.datetime.fromisoformat(now) - dt.timedelta(hours=hours)
    return logs.where(at.isNull() | (at >= F.lit(str(cutoff)).cast("timestamp")))


def period_start(period: str, now: dt.date) -> dt.date:
    """``7d``, ``2w``, ``1m`` (30 days) or an ISO date as a start date."""
    found = re.fullmatch(r"(\d+)([dwm])", period.strip().lower())
    if found:
        return now - dt.timedelta(days=int(found[1]) * {"d": 1, "w": 7, "m": 30}[found[2]])
    return dt.date.fromisoformat(period)


def period_filter(logs: DataFrame, period: str, now: str, ts: str = "ts") -> DataFrame:
    start = period_start(period, dt.date.fromisoformat(now))
    return logs.where(F.col(ts) >= F.lit(str(start)).cast(logs.schema[ts].dataType))


def filter_issues(issues: DataFrame, severity: str | None = None, text: str | None = None,
                  rule: str | None = None, category: str | None = None) -> DataFrame:
    """Severity equality, text in title or summary, rule text anywhere, category."""
    keep = F.lit(True)
    if severity:
        keep = keep & (F.lower("severity") == severity.lower())
    if text:
        low = text.lower()
        keep = keep & (F.lower("title").contains(low) | F.lower("summary").contains(low))
    if rule:
        low = rule.lower()
        keep = keep & (F.lower("summary").contains(low) | F.lower("title").contains(low)
                       | F.lower("recommendation").contains(low))
    if category:
        keep = keep & (F.col("category") == category)
    return issues.where(keep)


def issues_for_query(issues: DataFrame, query: str, recent: int = 10, keep: int = 5) -> DataFrame:
    """Newest issues that mention a word of the query."""
    newest = issues.orderBy(F.col("ts").desc(), F.col("issue_id")).limit(recent)
    hit = contains_any(F.lower("title"), query.lower().split()) | contains_any(F.lower("summary"), query.lower().split())
    return (newest.where(hit).orderBy(F.col("ts").desc(), F.col("issue_id")).limit(keep)
            .select("issue_id", "title", "severity", F.substring("summary", 1, 300).alias("summary")))


def query_summaries(summaries: DataFrame, level: str | None = None, start: str | None = None,
                    end: str | None = None, tags: list[str] | None = None, limit: int = 50) -> DataFrame:
    """Summary catalogue lookup: level, period bounds, any of the tags, newest first."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    keep = F.lit(True)
    if level:
        keep = keep & (F.col("level") == level)
    if start:
        keep = keep & (F.col("period_start") >= F.lit(start).cast("date"))
    if end:
        keep = keep & (F.col("period_end") <= F.lit(end).cast("date"))
    if tags:
        keep = keep & F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))
    return summaries.where(keep).orderBy(F.col("period_start").desc(), F.col("summary_id")).limit(limit)


def filter_summaries_text(summaries: DataFrame, query: str, text: str = "summary_text") -> DataFrame:
    """Summaries whose text holds any query term."""
    return summaries.where(contains_any(F.lower(text), query.lower().split()))


def scenario_filter(logs: DataFrame, filters: dict[str, object]) -> DataFrame:
    """A scalar filters by equality, a list by membership."""
    for column, wanted in filters.items():
        if isinstance(wanted, (list, tuple, set)):
            logs = logs.where(F.col(column).isin(list(wanted)))
        else:
            logs = logs.where(F.col(column) == wanted)
    return logs


def issue_order(issues: DataFrame, by: str = "severity", descending: bool = True) -> DataFrame:
    """Sort issues by time, severity rank or title; the id breaks ties."""
    rank = (F.when(F.lower("severity") == "critical", 4).when(F.lower("severity") == "high", 3)
            .when(F.lower("severity") == "medium", 2).otherwise(1))
    key = {"time": F.col("ts"), "severity": rank, "title": F.col("title")}[by]
    return issues.orderBy(key.desc() if descending else key.asc(), F.col("issue_id"))


def query_words(query: Column) -> Column:
    return words(F.lower(query))
