"""Cluster to day to week to month to quarter.

Each level reads the table of the level below, so a recomputed period touches
only its own partition. Row counts shrink by orders of magnitude at the first
step; the later steps are small whatever the size of the logs.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.functions.entities import alert_entities
from alertloom.operators import patterns as pt
from alertloom.operators.patterns import top_per_group
from alertloom.session import cut_lineage, spread

SEVERE = ["high", "critical"]


@dataclass
class ClusterLevel:
    """The tables of the cluster level."""

    rows: DataFrame
    base: DataFrame
    patterns: DataFrame
    activity: DataFrame
    common: DataFrame
    risk: DataFrame
    systems: DataFrame

    def stored(self) -> ClusterLevel:
        """The same level with its base, patterns and risk written out, each from the one before.

        Coarser levels then read a few rows per cluster; a lost executor costs one
        table. Activity, common elements and systems grow with the logs and stay
        computed on demand: most coarser levels need none or one of them.
        """
        base = cut_lineage(self.base, "base")
        found = cut_lineage(pt.patterns(self.rows, base), "patterns")
        return replace(self, base=base, patterns=found, risk=cut_lineage(pt.cluster_risk(base, found), "risk"),
                       common=pt.common_elements(self.rows, base))

    @property
    def texts(self) -> DataFrame:
        return pt.cluster_texts(self.base, self.patterns, self.activity, self.risk)

    @property
    def summaries(self) -> DataFrame:
        return pt.cluster_summaries(self.rows, self.base, self.patterns, self.activity, self.common, self.risk)

    @property
    def tags(self) -> DataFrame:
        return pt.cluster_tags(self.base, self.patterns, self.common)


def host_day_rows(alerts: DataFrame) -> DataFrame:
    """Alerts keyed by host and day, the grouping the daily report is built on.

    The address and the user of an alert are entities where it has these fields.
    """
    day = F.to_date("ts")
    declared = [c for c in ("src_ip", "src_user") if c in alerts.columns]
    return spread(alerts).select(
        F.concat(day.cast("string"), F.lit("/"), "agent_name").alias("cluster_id"), day.alias("day"), "alert_id", "sha256",
        "ts", "rule_id", F.split_part("full_log", F.lit(" for "), F.lit(1)).alias("rule_desc"), "rule_level", "agent_name",
        "location", "full_log", alert_entities(F.col("full_log"), declared).alias("entities"))


def cluster_level(rows: DataFrame) -> ClusterLevel:
    base = pt.cluster_base(rows)
    found = pt.patterns(rows, base)
    return ClusterLevel(
        rows=rows, base=base, patterns=found, activity=pt.entity_activity(rows), common=pt.common_elements(rows, base),
        risk=pt.cluster_risk(base, found), systems=pt.affected_systems(rows))


def risk_value(risk: Column) -> Column:
    return F.when(risk == "critical", 1.0).when(risk == "high", 0.8).when(risk == "medium", 0.6).otherwise(0.3)


# --- day ------------------------------------------------------------------------

def daily_incidents(c: ClusterLevel) -> DataFrame:
    """Severe patterns plus severe clusters, and the alert volume."""
    severe = c.patterns.groupBy("day").agg(F.count_if(F.col("severity").isin(SEVERE)).alias("p"))
    clusters = c.risk.join(c.base.select("cluster_id", "day", "n"), pt.KEY).groupBy("day").agg(
        F.count_if(F.col("risk").isin(SEVERE)).alias("k"), F.sum("n").alias("alert_volume"))
    return clusters.join(severe, "day", "left").select(
        "day", (F.col("k") + F.coalesce("p", F.lit(0))).alias("incidents"), "alert_volume")


def system_health(c: ClusterLevel) -> DataFrame:
    bad = F.when(F.col("risk").isin(SEVERE), F.col("system"))
    seen = c.systems.join(c.risk.select(*pt.KEY, "risk"), pt.KEY).groupBy("day").agg(
        F.countDistinct("system").alias("systems"), F.countDistinct(bad).alias("problem_systems"))
    share = F.col("problem_systems") / F.col("systems")
    return seen.withColumn("status", F.when(share > 0.5, "degraded").when(share > 0.2, "warning").otherwise("healthy"))


def compliance(c: ClusterLevel) -> DataFrame:
    hit = lambda word: F.coalesce(F.bool_or(F.lower("description").contains(word) & F.col("severity").isin(SEVERE)), F.lit(False))
    state = lambda broken, bad: F.when(F.coalesce(broken, F.lit(False)), bad).otherwise("compliant")
    found = c.patterns.groupBy("day").agg(hit("authentication").alias("auth"), hit("access").alias("access"))
    days = c.base.select("day").distinct()
    return days.join(found, "day", "left").select(
        "day", state(F.col("auth"), "violation").alias("authentication"),
        state(F.col("access"), "violation").alias("access_control"),
        state(F.col("auth") | F.col("access"), "non_compliant").alias("overall"))


def pattern_trends(c: ClusterLevel, top: int | None = None) -> DataFrame:
    """Pattern types with at least two occurrences per day, all or the ``top`` most frequent."""
    counted = c.patterns.groupBy("day", "pattern_type").agg(F.count("*").alias("n"))
    return top_per_group(counted, ["day"], [F.col("n").desc(), F.col("pattern_type")], top).where("n >= 2").select(
        "day", "pattern_type", "n", "rk",
        F.concat(F.when(F.col("pattern_type") == "brute_force", "Brute_Force").otherwise("Rule_Pattern"),
                 F.lit(" Pattern Frequency")).alias("trend_name"),
        F.when(F.col("n") > 3, "increasing").otherwise("stable").alias("direction"),
        F.least(F.lit(1.0), F.col("n") / 10).alias("confidence"),
        F.when(F.col("n") > 5, "high").otherwise("medium").alias("significance"))


def daily_metrics(c: ClusterLevel) -> DataFrame:
    trends = pattern_trends(c).groupBy("day").agg(
        F.count("*").alias("trends"), F.count_if(F.col("direction") == "increasing").alias("increasing"),
        F.count_if(F.col("direction") == "decreasing").alias("decreasing"))
    clusters = c.risk.join(c.base.select(*pt.KEY, "n"), pt.KEY).groupBy("day").agg(
        F.count("*").alias("clusters"), F.sum("n").alias("logs"), F.avg(risk_value(F.col("risk"))).alias("mean_risk"),
        F.max(risk_value(F.col("risk"))).alias("max_risk"))
    people = c.activity.groupBy("day").agg(F.countDistinct("entity").alias("entities"))
    pats = c.patterns.groupBy("day").agg(F.count("*").alias("patterns"), F.count_if(F.col("severity") == "critical").alias("critical_patterns"))
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return clusters.join(people, "day", "left").join(pats, "day", "left").join(trends, "day", "left").select(
        "day", "clusters", "logs", zero("entities"), "mean_risk", "max_risk", zero("patterns"), zero("critical_patterns"),
        zero("trends"), zero("increasing"), zero("decreasing"))


def daily_entities(c: ClusterLevel, top: int | None = None) -> DataFrame:
    """Cluster activity re-aggregated per day; distinct rules are counted on the logs."""
    rules = pt.mentions(c.rows).groupBy("day", "entity").agg(F.countDistinct("rule_id").alias("rules"))
    summed = c.activity.groupBy("day", "entity", "entity_type").agg(
        F.sum("activity").alias("activity"), F.sum("events").alias("events"), F.avg("risk").alias("risk"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("behaviors")))), ",").alias("behaviors"))
    best = top_per_group(summed, ["day"], [F.col("activity").desc(), F.col("entity")], top)
    return best.join(rules, ["day", "entity"])


def daily_findings(c: ClusterLevel, summaries: DataFrame | None = None, per_kind: int | None = None, top: int | None = None) -> DataFrame:
    """Findings per day, ranked: risky clusters, significant trends, repeated patterns.

    All of them, or the first ``per_kind`` of each kind and the first ``top`` in all.
    """
    within = F.lit(True) if per_kind is None else F.col("rk") <= per_kind
    summaries = c.summaries if summaries is None else summaries
    risky = top_per_group(summaries.where(F.col("risk").isin(SEVERE)), ["day"], [F.col("cluster_id")], per_kind).select(
        "day", F.col("rk").cast("bigint").alias("pos"), F.concat(F.lit("High-risk security cluster: "), F.substring("summary_text", 1, 100), F.lit("...")).alias("finding"))
    trends = pattern_trends(c)
    strong = trends.where(within & (F.col("significance") == "high")).select(
        "day", (F.col("rk") + pt.AFTER_RULES).cast("bigint").alias("pos"), F.concat(F.lit("Significant trend detected: "), "trend_name", F.lit(" - "), "direction").alias("finding"))
    repeated = trends.where(within).select(
        "day", (F.col("rk").cast("bigint") + 2 * pt.AFTER_RULES).alias("pos"), F.concat(F.lit("Multiple "), "pattern_type", F.lit(" patterns detected ("), "n", F.lit(" occurrences)")).alias("finding"))
    return top_per_group(risky.unionByName(strong).unionByName(repeated), ["day"], [F.col("pos")], top).select("day", "rk", "finding")


def fill_quiet(counts: DataFrame, keys: list[str], day: str = "day") -> DataFrame:
    """One row per day between the first and last day of each key; quiet days are marked."""
    span = counts.groupBy(*keys).agg(F.min(day).alias("d0"), F.max(day).alias("d1"))
    calendar = span.select(*keys, F.explode(F.sequence("d0", "d1")).alias(day))
    return calendar.join(counts, [*keys, day], "left").select(
        *keys, day, F.coalesce("incidents", F.lit(0)).alias("incidents"),
        F.when(F.col("incidents").isNull(), 1.0).otherwise(F.col("quality")).alias("quality"),
        F.when(F.col("incidents").isNull(), "quiet_day,no_incidents").otherwise("").alias("tags"))


# --- week -----------------------------------------------------------------------

def week_of(day: str = "day") -> Column:
    return F.date_trunc("week", day).cast("date")


def direction(slope: Column, threshold: float = 0.1) -> Column:
    return F.when(slope.isNull() | (F.abs(slope) < threshold), "stable").when(slope > 0, "increasing").otherwise("decreasing")


def slope_by(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Least-squares slope of a series on 0..n-1 in chronological order, with its range."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return series.withColumn("i", at).groupBy(*keys).agg(
        F.count("*").alias("points"), F.regr_slope(F.col(value).cast("double"), F.col("i").cast("double")).alias("slope"),
        (F.max(value) - F.min(value)).alias("magnitude"), F.max(value).alias("peak"))


def weekly_trend(incidents: DataFrame) -> DataFrame:
    """Direction of the daily incident counts of each week."""
    series = slope_by(incidents.withColumn("week", week_of()), ["week"], "day", "incidents")
    return series.select("week", "points", direction(F.col("slope")).alias("direction"), "slope", "magnitude",
                         F.when(F.col("peak") > 10, "high").otherwise("medium").alias("significance"))


def major_incidents(incidents: DataFrame, trends: DataFrame, top: int | None = None) -> DataFrame:
    """Days with many incidents and every highly significant trend, all or the first ``top`` of a week."""
    volume = incidents.where("incidents >= 5").select(
        "day", F.lit(0).alias("kind"), F.concat(F.lit("High incident volume: "), "incidents", F.lit(" incidents")).alias("description"),
        F.when(F.col("incidents") >= 10, "high").otherwise("medium").alias("severity"))
    critical = trends.where("significance = 'high'").select(
        "day", F.col("rk").alias("kind"), F.concat(F.lit("Critical security trend: "), "trend_name").alias("description"),
        F.lit("critical").alias("severity"))
    both = volume.unionByName(critical).withColumn("week", week_of())
    return top_per_group(both, ["week"], [F.col("day"), F.col("kind")], top)


def weekly_entities(daily: DataFrame, top: int | None = None) -> DataFrame:
    """Entity behaviour over a week from the daily entities, all or the ``top`` of highest risk."""
    week = daily.withColumn("week", week_of()).groupBy("week", "entity", "entity_type").agg(
        F.sum("activity").alias("total"), F.sum(F.col("activity") * F.col("activity")).alias("squares"),
        F.count("*").alias("days"), F.sum("events").alias("events"))
    # From sums: those of whole numbers are exact, so half the mean compares alike in any order of the rows.
    days, total = F.col("days"), F.col("total")
    week = week.withColumn("activity", total / days).withColumn("variance", (days * F.col("squares") - total * total) / (days * days)).drop("total", "squares")
    flags = F.concat_ws(",", F.when(F.col("variance") > F.col("activity") * 0.5, "irregular_activity_pattern"),
                        F.when(F.col("days") == 1, "single_day_activity").when(F.col("days") >= 6, "persistent_activity"))
    scored = week.withColumn("flags", flags).withColumn(
        "risk", F.least(F.lit(1.0), F.col("variance") + F.col("days") / 7))
    return top_per_group(scored, ["week"], [F.col("risk").desc(), F.col("entity")], top)


def campaigns(trends: DataFrame, top: int | None = None) -> DataFrame:
    """Pattern trends on at least three days of a week, all or the first ``top`` by name."""
    week = trends.withColumn("week", week_of()).groupBy("week", "trend_name").agg(
        F.min("day").alias("start"), F.max("day").alias("end"), F.countDistinct("day").alias("days"),
        F.sum("n").alias("magnitude"), F.avg("confidence").alias("confidence"),
        # at most seven rows: the input has one row per day and trend
        F.sort_array(F.collect_list(F.struct("day", "n"))).alias("steps"))
    named = week.where("days >= 3").withColumn("campaign", F.concat(F.lit("Sustained "), "trend_name")).withColumn(
        "evolution", F.array_join(F.transform("steps", lambda s: F.concat(s["day"].cast("string"), F.lit("="), s["n"])), ";")).drop("steps")
    return top_per_group(named, ["week"], [F.col("campaign")], top)


# --- month and quarter -------------------------------------------------------------

def entity_trends(weekly: DataFrame, top: int | None = None) -> DataFrame:
    """Entities whose weekly activity rises or falls within a month, all or the first ``top`` by name."""
    month = F.date_trunc("month", "week").cast("date")
    series = slope_by(weekly.withColumn("month", month), ["month", "entity"], "week", "activity")
    moving = series.where("points > 1").withColumn("direction", direction(F.col("slope"))).where("direction <> 'stable'")
    return top_per_group(moving, ["month"], [F.col("entity")], top)


def kpi_trends(kpis: DataFrame, period: str, grain: str = "quarter") -> DataFrame:
    """Slope of each KPI over the months of a quarter; ``kpis`` is (period, kpi, value)."""
    keyed = kpis.withColumn("quarter", F.date_trunc(grain, period).cast("date"))
    series = slope_by(keyed, ["quarter", "kpi"], period, "value").where("points > 1")
    return series.withColumn("direction", direction(F.col("slope"))).where("direction <> 'stable'")


def quarterly_quality(months: DataFrame, trends: DataFrame) -> DataFrame:
    """Quality and tags per quarter from (month, quality, source_count) and its trends."""
    quarter = F.date_trunc("quarter", "month").cast("date")
    per = months.withColumn("quarter", quarter).groupBy("quarter").agg(
        F.count("*").alias("months"), F.avg("quality").alias("source_quality"), F.sum("source_count").alias("sources"))
    n = trends.groupBy("quarter").agg(F.count("*").alias("t"))
    complete = F.least(F.lit(1.0), F.col("months") / 3)
    trend = F.when(F.col("t").isNull(), 0.5).otherwise(F.least(F.lit(1.0), F.col("t") / 5))
    has = F.col("t").isNotNull()
    tags = F.array_sort(F.array_compact(F.array(
        F.lit("quarterly"), F.lit("executive"), F.concat(F.lit("Q"), F.quarter("quarter")), F.concat(F.lit("year_"), F.year("quarter")),
        F.when(has, "strategic_metrics"), F.when(has, "high_significance"),
        F.when(F.col("sources") > 1000, "high_volume").when(F.col("sources") < 100, "low_volume"))))
    return per.join(n, "quarter", "left").select(
        "quarter", ((complete + trend + F.col("source_quality")) / 3).alias("quality"), F.array_join(tags, ",").alias("tags"))


def period_comparison(totals: DataFrame, period: str, value: str, grains: list[str]) -> DataFrame:
    """Each period against the one before, per grain: difference and percent.

    ``totals`` is one row per day, so the window sees one row per period.
    """
    stacked = totals.select(F.explode(F.array(*[F.struct(
        F.lit(g).alias("grain"), F.date_trunc(g, period).cast("date").alias("start")) for g in grains])).alias("p"), value)
    summed = stacked.groupBy("p.grain", "p.start").agg(F.sum(value).alias("total"))
    before = F.lag("total").over(Window.partitionBy("grain").orderBy("start"))
    return summed.withColumn("before", before).where("before IS NOT NULL").select(
        "grain", "start", "total", (F.col("total") - F.col("before")).alias("change"),
        ((F.col("total") - F.col("before")) * 100 / F.col("before")).alias("percent"))


def executive_kpis(metrics: DataFrame, incidents: DataFrame, status: DataFrame, found_campaigns: DataFrame) -> DataFrame:
    """Monthly KPI row from the daily tables."""
    month = lambda day: F.date_trunc("month", day).cast("date").alias("month")
    runs = found_campaigns.groupBy(month("week")).agg(F.count("*").alias("campaigns"))
    joined = metrics.join(incidents, "day").join(status, "day")
    return joined.groupBy(month("day")).agg(
        F.sum("incidents").alias("incidents"), F.sum("alert_volume").alias("alerts"), F.avg("mean_risk").alias("mean_risk"),
        F.count_if(F.col("overall") == "non_compliant").alias("violations"), F.count("*").alias("days"),
    ).join(runs, "month", "left").withColumn("campaigns", F.coalesce("campaigns", F.lit(0)))


# --- summary catalogue -----------------------------------------------------------------

#: levels above the day: name, grain and last day of a period ``p``
COARSER = (("weekly", "week", lambda p: F.date_add(p, 6)), ("monthly", "month", F.last_day))


def period_rows(df: DataFrame, level: str, name: str, start: str, end: Column, *more: Column) -> DataFrame:
    return df.select(F.lit(level).alias("level"), F.concat(F.lit(f"{level}_"), F.col(name).cast("string")).alias("summary_id"),
                     F.col(start).cast("date").alias("period_start"), end.cast("date").alias("period_end"), *more)


def summary_periods(clusters: DataFrame) -> DataFrame:
    """Level, id and period of every summary: the catalogue without texts and tags.

    ``clusters`` is (cluster_id, day). Order and lineage need no more, so no text is
    searched for them.
    """
    days = clusters.select("day").distinct()
    out = period_rows(clusters.where("cluster_id IS NOT NULL"), "cluster", "cluster_id", "day", F.col("day")).unionByName(
        period_rows(days, "daily", "day", "day", F.col("day")))
    for level, grain, end in COARSER:
        starts = days.select(F.date_trunc(grain, "day").cast("date").alias("p")).distinct()
        out = out.unionByName(period_rows(starts, level, "p", "p", end("p")))
    return out


def summary_catalog(c: ClusterLevel, texts: DataFrame | None = None) -> DataFrame:
    """Cluster, daily, weekly and monthly summaries in one table with lineage keys."""
    texts = c.texts if texts is None else texts
    incidents = daily_incidents(c)
    row = lambda df, level, name, start, end, text, tags: period_rows(
        df, level, name, start, end, text.alias("summary_text"), tags.alias("tags"))
    cluster = row(texts, "cluster", "cluster_id", "day", F.col("day"), F.col("summary_text"), F.array("risk"))
    state = lambda col: F.when(col == 0, F.array(F.lit("no_incidents"))).otherwise(F.array(F.lit("incidents")))
    text = lambda label, at: F.concat(F.lit(f"Security operations {label} "), at.cast("string"), F.lit(" identified "), "incidents",
                                      F.lit(" incidents from "), "alert_volume", F.lit(" alerts."))
    out = cluster.unionByName(row(incidents, "daily", "day", "day", F.col("day"), text("on", F.col("day")), state(F.col("incidents"))))
    for level, grain, end in COARSER:
        summed = incidents.groupBy(F.date_trunc(grain, "day").cast("date").alias("p")).agg(
            F.sum("incidents").alias("incidents"), F.sum("alert_volume").alias("alert_volume"))
        out = out.unionByName(row(summed, level, "p", "p", end("p"), text("from", F.col("p")), state(F.col("incidents"))))
    return out


def lineage_edges(catalog: DataFrame) -> DataFrame:
    """(parent, child) edges between adjacent levels of the catalogue."""
    from alertloom.operators.joins import in_period

    level = lambda name: catalog.where(F.col("level") == name)
    pick = lambda df: df.select(F.col("parent_id").alias("parent"), F.col("summary_id").alias("child"))
    return (pick(in_period(level("cluster"), level("daily"), "day"))
            .unionByName(pick(in_period(level("daily"), level("weekly"), "week")))
            .unionByName(pick(in_period(level("weekly"), level("monthly"), "month"))))
