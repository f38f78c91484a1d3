"""Metrics, patterns, entity activity and risk of log clusters.

Input rows carry ``cluster_id, day, sha256, ts, rule_id, rule_desc, rule_level,
agent_name, location, full_log`` and ``entities`` (computed once per log). Every
step is a partial aggregation on the cluster key: a cluster that holds a third
of all rows is reduced inside each task before it is shuffled. Lists are built
only after a per-group rank limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom import config
from alertloom.functions.entities import entity_type
from alertloom.functions.matching import contains_any, exploded

KEY = ["cluster_id", "day"]
NIGHT = [23, 0, 1, 2, 3, 4, 5]
#: place of other patterns behind all rule patterns
AFTER_RULES = 1_000_000_000


def level_severity(level: Column) -> Column:
    return F.when(level >= 12, "critical").when(level >= 7, "high").when(level >= 4, "medium").otherwise("low")


def severity_score(severity: Column) -> Column:
    return (F.when(severity == "critical", 1.0).when(severity == "high", 0.8)
            .when(severity == "medium", 0.6).when(severity == "low", 0.3).otherwise(0.5))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int | None, rank: str = "rk") -> DataFrame:
    """Ranked rows per group, the best ``n`` if given. Spark then limits each task to ``n`` per group first."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if n is None else ranked.where(F.col(rank) <= n)


def joined_list(df: DataFrame, keys: list[str], rank: str, value: Column, name: str, sep: str = ", ") -> DataFrame:
    """Ranked rows of a group as one text; callers limit the group first."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), value.alias("v"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["v"]), sep).alias(name))


def cluster_base(rows: DataFrame) -> DataFrame:
    """Size, time span, levels and phrase counts per cluster in one aggregation."""
    low = F.lower("full_log")
    return rows.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.coalesce(F.avg("rule_level") / 15, F.lit(0.5)).alias("risk_score"), F.max("rule_level").alias("max_level"),
        F.count_if(F.col("rule_level") >= 10).alias("severe"),
        F.count_if(F.hour("ts").isin(NIGHT)).alias("night"),
        F.count_if(F.weekday("ts") >= 5).alias("weekend"),
        F.count_if(contains_any(low, config.FAILURE_PHRASES)).alias("failures"),
        F.count_if(contains_any(low, config.LOGIN_PHRASES)).alias("logins"),
    ).withColumn("span_hours", (F.unix_micros(F.col("last_ts").cast("timestamp"))
                                - F.unix_micros(F.col("first_ts").cast("timestamp"))) / 3.6e9)


def cluster_metrics(rows: DataFrame, cluster: str, features: list[Column]) -> DataFrame:
    """Centroid and coherence, 1 / (1 + population variance of the distances).

    One aggregate per dimension instead of one row per dimension: nothing is
    exploded. The centroid table has one row per cluster; how it is joined back
    is left to Spark's size estimate.
    """
    named = rows.select(cluster, *[f.cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    centroid = named.groupBy(cluster).agg(*[F.avg(f"f{i}").alias(f"c{i}") for i in range(len(features))])
    square = F.lit(0.0)
    for i in range(len(features)):
        square = square + (F.col(f"f{i}") - F.col(f"c{i}")) * (F.col(f"f{i}") - F.col(f"c{i}"))
    spread = named.join(centroid, cluster).groupBy(cluster).agg(
        F.count("*").alias("n"), F.var_pop(F.sqrt(square)).alias("v"))
    return spread.join(centroid, cluster).select(
        cluster, "n", (1 / (1 + F.col("v"))).alias("coherence"),
        F.array(*[F.col(f"c{i}") for i in range(len(features))]).alias("centroid"))


def temporal_features(ts: Column) -> list[Column]:
    """Hour, weekday, day of month and years since the epoch, scaled; zeros without a time."""
    at = ts.cast("timestamp")
    parts = [F.hour(ts) / 24, F.weekday(ts) / 7, F.dayofmonth(ts) / 31, F.unix_micros(at) / 1e6 / (365 * 24 * 3600)]
    return [F.coalesce(p.cast("double"), F.lit(0.0)) for p in parts]


def mentions(rows: DataFrame) -> DataFrame:
    """One row per log and entity."""
    return exploded(rows, [*KEY, "sha256", "ts", "rule_id", "full_log"], F.col("entities"), "entity")


def common_elements(rows: DataFrame, base: DataFrame, share: float = 0.5) -> DataFrame:
    """Entities and rules in at least half of a cluster's logs."""
    rule = F.concat("rule_id", F.lit(": "), "rule_desc")
    items = exploded(rows, KEY, F.concat(
        F.transform("entities", lambda e: F.struct(F.lit("entity").alias("kind"), e.alias("value"))),
        F.array(F.struct(F.lit("rule").alias("kind"), rule.alias("value")))), "x").select(*KEY, "x.*")
    counted = items.groupBy(*KEY, "kind", "value").agg(F.count("*").alias("logs"))
    return counted.join(base.select(*KEY, "n"), KEY).where(F.col("logs") >= share * F.col("n")).drop("n")


def rule_patterns(rows: DataFrame, base: DataFrame, top: int | None = None) -> DataFrame:
    """Rules that fired at least twice in a cluster, all or the ``top`` most frequent."""
    counted = rows.groupBy(*KEY, F.concat("rule_id", F.lit(": "), "rule_desc").alias("rule")).agg(F.count("*").alias("c"))
    top = top_per_group(counted, KEY, [F.col("c").desc(), F.col("rule")], top).where("c >= 2")
    return top.join(base.select(*KEY, "n", "max_level"), KEY).select(
        *KEY, F.lit("rule_pattern").alias("pattern_type"),
        F.concat(F.lit("Multiple occurrences of: "), "rule").alias("description"),
        F.least(F.lit(0.9), F.col("c") / F.col("n")).alias("confidence"),
        level_severity(F.col("max_level")).alias("severity"), F.col("c").alias("occurrences"), F.col("rk").alias("ord"))


def brute_force(base: DataFrame) -> DataFrame:
    """Clusters with many authentication failures."""
    f, a = F.col("failures"), F.col("logins")
    return base.where((f >= 5) | ((a >= 10) & (f >= 3))).select(
        *KEY, F.lit("brute_force").alias("pattern_type"),
        F.concat(F.lit("Potential brute force attack: "), f, F.lit(" authentication failures, "), a,
                 F.lit(" login attempts")).alias("description"),
        F.least(F.lit(0.9), (f + a) / 20).alias("confidence"),
        F.when(f >= 10, "high").otherwise("medium").alias("severity"), (f + a).alias("occurrences"), F.lit(AFTER_RULES).alias("ord"))


def patterns(rows: DataFrame, base: DataFrame) -> DataFrame:
    return rule_patterns(rows, base).unionByName(brute_force(base))


def entity_activity(rows: DataFrame, top: int | None = None) -> DataFrame:
    """Entities of a cluster by activity with their behaviours, all or the ``top`` most active."""
    low = F.lower("full_log")
    # A text is searched once, not once per entity.
    shown = {"login": low.contains("login"), "file_access": low.contains("file"),
             "network_activity": low.contains("network") | low.contains("connection")}
    logs = rows.select(*KEY, "ts", "rule_id", "entities", *[c.alias(name) for name, c in shown.items()])
    stats = exploded(logs, [*KEY, "ts", "rule_id", *shown], F.col("entities"), "entity").groupBy(*KEY, "entity").agg(
        F.count("*").alias("events"), F.countDistinct("rule_id").alias("rules"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), *[F.bool_or(name).alias(name) for name in shown],
    ).where("events >= 2")
    scored = stats.select(
        *KEY, "entity", entity_type(F.col("entity")).alias("entity_type"), "events", "rules", "first_seen", "last_seen",
        F.array_compact(F.array(*[F.when(F.col(b), F.lit(b)) for b in ("file_access", "login", "network_activity")])).alias("behaviors"),
        F.least(F.lit(10.0), (F.col("events") * F.col("rules")).cast("double")).alias("activity"),
        F.least(F.lit(1.0), F.col("rules") / 10).alias("risk"))
    return top_per_group(scored, KEY, [F.col("activity").desc(), F.col("entity")], top)


def anomalies(base: DataFrame, size_limit: int = config.CLUSTER_MAX) -> DataFrame:
    """Unusual hours, weekends, volume and severity per cluster."""
    n = F.col("n")
    enough = n > 3
    text = lambda head, count, tail: F.concat(F.lit(head), F.col(count), F.lit("/"), n, F.lit(tail))
    found = F.array_compact(F.array(
        F.when(enough & (F.col("night") > n * 0.7), text("Unusual after-hours activity: ", "night", " events during night hours")),
        F.when(enough & (F.col("weekend") > n * 0.8), text("High weekend activity: ", "weekend", " events on weekends")),
        F.when(n > size_limit * 0.5, F.concat(F.lit("High event volume: "), n, F.lit(" events in cluster"))),
        F.when(F.col("severe") > n * 0.3, text("High proportion of high-severity events: ", "severe", "")),
    ))
    return base.select(*KEY, found.alias("anomalies"))


def cluster_risk(base: DataFrame, found: DataFrame) -> DataFrame:
    """Mean of pattern, size and rule risk as a level."""
    worst = found.groupBy(*KEY).agg(F.max(severity_score(F.col("severity"))).alias("worst"), F.count("*").alias("n_patterns"))
    size = F.when(F.col("n") > 30, 0.8).when(F.col("n") > 10, 0.6).otherwise(0.3)
    rest = size + F.col("risk_score")
    mean = F.when(F.col("worst").isNull(), rest / 2).otherwise((F.col("worst") + rest) / 3)
    level = F.when(mean >= 0.8, "critical").when(mean >= 0.6, "high").when(mean >= 0.4, "medium").otherwise("low")
    return base.join(worst, KEY, "left").select(*KEY, mean.alias("risk_mean"), level.alias("risk"),
                                                F.coalesce("n_patterns", F.lit(0)).alias("n_patterns"))


def affected_systems(rows: DataFrame, first: int | None = None) -> DataFrame:
    """Agents and location hosts per cluster, all or the ``first`` by name."""
    host = F.split_part("location", F.lit("->"), F.lit(1))
    names = rows.select(*KEY, F.explode(F.array("agent_name", host)).alias("system")).where(F.col("system") != "").distinct()
    return names if first is None else top_per_group(names, KEY, [F.col("system")], first)


def cluster_tags(base: DataFrame, found: DataFrame, common: DataFrame) -> DataFrame:
    """Tags from patterns, common rules, volume and duration: one row per tag."""
    tags = found.select(*KEY, F.explode(F.array("pattern_type", "severity")).alias("tag"))
    low = F.lower("value")
    rules = common.where("kind = 'rule'").select(*KEY, F.explode(F.array_compact(F.array(
        F.when(low.contains("ssh"), "ssh"), F.when(contains_any(low, ["web", "http"]), "web"),
        F.when(contains_any(low, ["auth", "login"]), "authentication")))).alias("tag"))
    shape = base.select(*KEY, F.explode(F.array_compact(F.array(
        F.when(F.col("n") > 50, "high_volume").when(F.col("n") < 5, "low_volume"),
        F.when(F.col("span_hours") > 24, "extended_duration").when(F.col("span_hours") * 3600 < 300, "rapid_sequence")))).alias("tag"))
    return tags.unionByName(rules).unionByName(shape).distinct()


def hours() -> Column:
    return F.format_string("%.1f", F.round("span_hours", 1))


def cluster_texts(base: DataFrame, found: DataFrame, active: DataFrame, risk: DataFrame) -> DataFrame:
    """Template text of each cluster."""
    main = found.groupBy(*KEY).agg(F.min_by(F.struct("description", "confidence"), "ord").alias("main"))
    named = joined_list(active.where("rk <= 3"), KEY, "rk", F.col("entity"), "key_entities")
    text = F.concat_ws(
        " ",
        F.concat(F.lit("Security cluster containing "), "n", F.lit(" events over "), hours(), F.lit(" hours.")),
        F.when(F.col("main").isNotNull(), F.concat(
            F.lit("Primary pattern: "), F.col("main.description"), F.lit(" (confidence: "),
            F.format_string("%.2f", F.round("main.confidence", 2)), F.lit(")."))),
        F.when(F.col("key_entities").isNotNull(), F.concat(F.lit("Key entities involved: "), "key_entities", F.lit("."))),
        F.concat(F.lit("Risk level: "), "risk", F.lit(".")))
    whole = base.join(risk.select(*KEY, "risk"), KEY).join(main, KEY, "left").join(named, KEY, "left")
    return whole.withColumn("summary_text", text).select(*KEY, "n", "first_ts", "last_ts", "span_hours", "risk", "summary_text")


def cluster_summaries(rows: DataFrame, base: DataFrame, found: DataFrame, active: DataFrame, common: DataFrame,
                      risk: DataFrame) -> DataFrame:
    """One summary row per cluster: template text, insights, token estimate."""
    title = F.when(F.col("pattern_type") == "brute_force", "Brute_Force").otherwise("Rule_Pattern")
    top3 = top_per_group(found, KEY, [F.col("ord")], 3).select(
        *KEY, F.col("rk").alias("pos"), F.concat(title, F.lit(" detected: "), "description").alias("insight"))
    shared = joined_list(top_per_group(common.where("kind = 'entity'"), KEY, [F.col("value")], 5), KEY, "rk",
                         F.col("value"), "shared")
    seconds = F.col("span_hours") * 3600
    others = base.join(shared, KEY, "left").select(*KEY, F.posexplode(F.array_compact(F.array(
        F.when(F.col("shared").isNotNull(), F.concat(F.lit("Common entities across events: "), "shared")),
        F.when(F.col("span_hours") > 24, F.concat(F.lit("Extended activity period: "), hours(), F.lit(" hours")))
        .when(seconds < 300, "Rapid sequence of events within 5 minutes"),
        F.when(F.col("n") > 20, F.concat(F.lit("High event volume: "), "n", F.lit(" related events")))))).alias("pos", "insight"))
    all_insights = top3.unionByName(others.withColumn("pos", F.col("pos") + 10))
    insights = joined_list(top_per_group(all_insights, KEY, [F.col("pos")], 5), KEY, "rk", F.col("insight"), "insights", " | ")
    return cluster_texts(base, found, active, risk).join(insights, KEY, "left").select(
        *KEY, "n", "first_ts", "last_ts", "span_hours", "risk", "summary_text",
        F.coalesce("insights", F.lit("")).alias("insights"),
        (F.size(F.split("summary_text", " ")) * 1.3).alias("tokens"))


def largest_cluster(base: DataFrame, by: list[str]) -> DataFrame:
    """Biggest cluster per group; the smaller id wins a tie."""
    best = F.min(F.struct((-F.col("n")).alias("negative"), "cluster_id"))
    return base.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.cluster_id"), (-F.col("b.negative")).alias("n"))
