"""Stored tables and streams over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.catalog.base import Tables, query, with_alerts
from alertloom.catalog.guard import ACCEPTANCE, AUDIT, CONSISTENCY, audit, session_activity
from alertloom.catalog.logs import ISSUES
from alertloom.catalog.rollups import CATALOG, DAILY, SUMMARY, catalog, chain, periods
from alertloom.operators import counts, issues as iss, joins
from alertloom.plans import rollup as ro
from alertloom.session import scratch_dir
from alertloom.sources import stores
from alertloom.sources.alerts import alerts_from_events
from alertloom.streaming import jobs

us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))


class StreamTables(Tables):
    """The event table as a stream of files; other tables as usual."""

    def __init__(self, spark, sf_dir):
        super().__init__(spark, sf_dir)
        self.beats = scratch_dir(spark, "beats")

    @property
    def events(self):
        schema = self.spark.read.parquet(f"{self.sf_dir}/events.parquet").schema
        stream = self.spark.readStream.schema(schema).parquet(f"{self.sf_dir}/events*.parquet")
        # The watermark needs a timestamp with zone; the session zone is UTC.
        return jobs.with_heartbeats(stream, self.spark, self.beats).withColumn("ts", F.col("ts").cast("timestamp"))

    def close(self):
        """A heartbeat long after the last event: all windows, timers and sessions of the events end."""
        jobs.heartbeat(self.spark, self.spark.read.parquet(f"{self.sf_dir}/events.parquet").schema, self.beats, "2100-01-01 00:00:00")

    def run(self, stream, label):
        return jobs.run_to_table(stream, self.spark, label, then=self.close)


def streamed(t: Tables) -> StreamTables:
    return StreamTables(t.spark, t.sf_dir)


# --- stored tables -----------------------------------------------------------------------

@query("src05_write_log_store", with_alerts("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS dt, count(*) AS logs, count(DISTINCT sha256) AS hashes FROM alerts GROUP BY 1"""))
def _(t: Tables):
    path = scratch_dir(t.spark, "logs")
    alerts = t.alerts
    stores.write_log_store(alerts.where("rule_level >= 5"), path)
    stores.write_log_store(alerts, path)
    return t.spark.read.parquet(path).groupBy(F.col("dt").cast("string").alias("dt")).agg(
        F.count("*").alias("logs"), F.countDistinct("sha256").alias("hashes"))


@query("src06_write_summaries", chain("""SELECT level, summary_id, CASE WHEN level = 'daily' THEN summary_text || ' (revised)' ELSE summary_text END AS summary_text,
  CAST(year(period_start) AS INTEGER) AS year FROM catalog""", SUMMARY, DAILY, CATALOG))
def _(t: Tables):
    path = scratch_dir(t.spark, "summaries")
    rows = catalog(t)
    stores.write_summaries(rows, path)
    daily = t.spark.read.parquet(path).where("level = 'daily'")
    stores.write_summaries(daily.withColumn("summary_text", F.concat("summary_text", F.lit(" (revised)"))), path)
    return t.spark.read.parquet(path).select("level", "summary_id", "summary_text", "year")


@query("src07_verify_checksum", """SELECT doc_id AS summary_id, lang AS level FROM documents WHERE doc_id % 7 <> 2""")
def _(t: Tables):
    stored = stores.with_checksum(t.documents.select(F.col("doc_id").alias("summary_id"), F.col("lang").alias("level"), F.col("text").alias("summary_text")))
    damaged = stored.withColumn("summary_text", F.when(F.col("summary_id") % 7 == 2, F.concat("summary_text", F.lit(" "))).otherwise(F.col("summary_text")))
    return stores.verified(damaged).select("summary_id", "level")


@query("src11_metrics_snapshot", """SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1""")
def _(t: Tables):
    path = scratch_dir(t.spark, "snapshot")
    part = lambda cond: t.events.where(cond).groupBy("event_type").agg(F.count("*").alias("n"))
    part("event_id % 2 = 0").write.mode("overwrite").parquet(path)
    merged = counts.merge_snapshots(t.spark.read.parquet(path), part("event_id % 2 = 1"), "event_type")
    return merged.select("event_type", "n")


@query("src12_retention_purge", chain("""
e AS (SELECT *, period_start AS created FROM catalog),
gone AS (SELECT summary_id FROM e WHERE created < DATE '2024-04-09' - CASE level WHEN 'cluster' THEN 90 WHEN 'daily' THEN 80 WHEN 'weekly' THEN 730 ELSE 1825 END)
SELECT 'summary' AS kind, summary_id AS id FROM e WHERE summary_id NOT IN (FROM gone)
UNION ALL SELECT 'edge', parent || '>' || child FROM edges WHERE parent NOT IN (FROM gone) AND child NOT IN (FROM gone)""", SUMMARY, DAILY, CATALOG))
def _(t: Tables):
    rows = periods(t).where("summary_id IS NOT NULL").withColumn("created_at", F.col("period_start"))
    days = {"cluster": 90, "daily": 80, "weekly": 730, "monthly": 1825, "quarterly": 3650}
    gone = stores.expired(rows, F.lit("2024-04-09").cast("date"), days=days).select("summary_id")
    edges = (ro.lineage_edges(rows).join(gone.withColumnRenamed("summary_id", "parent"), "parent", "left_anti")
             .join(gone.withColumnRenamed("summary_id", "child"), "child", "left_anti"))
    return rows.join(gone, "summary_id", "left_anti").select(F.lit("summary").alias("kind"), F.col("summary_id").alias("id")).unionByName(
        edges.select(F.lit("edge").alias("kind"), F.concat("parent", F.lit(">"), "child").alias("id")))


# --- ingest ----------------------------------------------------------------------------------

INGEST = """SELECT event_id FROM events WHERE event_id % 10 <> 3"""


def written_lines(t: Tables) -> str:
    """The events as JSON lines, every tenth one cut short."""
    path = scratch_dir(t.spark, "lines")
    line = F.to_json(F.struct("event_id", "event_type", "user_id", "props"))
    broken = F.when(F.col("event_id") % 10 == 3, F.substring(line, F.lit(1), F.length(line) - 4)).otherwise(line)
    t.events.repartition(4).select(broken.alias("value")).write.mode("overwrite").text(path)
    return path


def ingested(t: Tables, part: str):
    source = written_lines(t)
    root = scratch_dir(t.spark, "ingest")
    stream = jobs.read_alert_stream(t.spark, source, "event_id BIGINT, event_type STRING, user_id BIGINT, props STRING", max_files=2)
    jobs.ingest(stream, f"{root}/good", f"{root}/bad", f"{root}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{root}/{part}")


@query("src03_incremental_ingest", INGEST)
def _(t: Tables):
    return ingested(t, "good").select("event_id")


@query("st01_stream_ingest", "SELECT count(*) AS quarantined FROM events WHERE event_id % 10 = 3")
def _(t: Tables):
    return ingested(t, "bad").agg(F.count("*").alias("quarantined"))


# --- streams -----------------------------------------------------------------------------------

@query("st02_stream_dedup", "SELECT DISTINCT sha256(event_type || '|' || user_id || '|' || CAST(CAST(ts AS DATE) AS VARCHAR)) AS sha256 FROM events")
def _(t: Tables):
    s = streamed(t)
    logs = s.events.select("ts", F.sha2(F.concat("event_type", F.lit("|"), "user_id", F.lit("|"), F.to_date("ts").cast("string")), 256).alias("sha256"))
    # equal hashes are of one day, so a day of state is enough
    return s.run(jobs.dedup_stream(logs, delay="1 day"), "dedup").select("sha256").where("sha256 IS NOT NULL")


@query("st03_minute_counts", """SELECT epoch_us(date_trunc('minute', ts)) AS minute_us, count(*) AS n FROM events GROUP BY 1""")
def _(t: Tables):
    s = streamed(t)
    return s.run(jobs.minute_counts(s.events), "minutes").select(us("window.start").alias("minute_us"), "n")


@query("st04_sliding_rates", """WITH e AS (SELECT event_type AS kind, epoch_us(ts) AS t FROM events),
w AS (SELECT kind, CAST(floor(t / 600000000) - k AS BIGINT) * 600000000 AS start FROM e, range(6) r(k))
SELECT kind, start AS start_us, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(*) >= 6""")
def _(t: Tables):
    s = streamed(t)
    events = s.events.select("ts", F.col("event_type").alias("kind"))
    return s.run(jobs.sliding_rates(events, 3600, 600, 6), "sliding").select("kind", us("window.start").alias("start_us"), "n")


@query("st05_stream_rate_limit", ACCEPTANCE + """, v AS (SELECT *, count(*) FILTER (WHERE NOT accepted) OVER (PARTITION BY ip ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
  FROM walk WHERE rn > 0)
SELECT event_id AS request_id, ip, CASE WHEN earlier > 10 THEN 'blocked' WHEN accepted THEN 'pass' ELSE 'limited' END AS verdict,
  least(earlier + CASE WHEN accepted THEN 0 ELSE 1 END, 11) AS violations FROM v""")
def _(t: Tables):
    s = streamed(t)
    requests = s.events.select(F.col("event_id").alias("request_id"), F.col("event_type").alias("ip"), "ts", us("ts").alias("ts_us"))
    out = s.run(jobs.rate_limit_stream(requests, limit=8, window_s=3600, burst=2, burst_s=600), "limit")
    return out.select("request_id", "ip", "verdict", "violations")


@query("st06_stream_lockout", """WITH c AS (SELECT event_type AS user_id, epoch_us(ts) AS ts_us,
  count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n FROM events)
SELECT DISTINCT user_id, ts_us FROM c WHERE n >= 5""")
def _(t: Tables):
    s = streamed(t)
    failures = s.events.select("ts", F.col("event_type").alias("user_id"), us("ts").alias("ts_us"), "event_id")
    return s.run(jobs.lockout_stream(failures, minutes=60), "lockout")


@query("st07_sessions", """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
walk AS (SELECT user_id, rn, t, t AS start, 1 AS part FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.rn, e.t, CASE WHEN e.t - w.t >= 21600000000 OR e.t - w.start >= 28800000000 THEN e.t ELSE w.start END,
    CASE WHEN e.t - w.t >= 21600000000 THEN 1 WHEN e.t - w.start >= 28800000000 THEN w.part + 1 ELSE w.part END FROM walk w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
SELECT user_id, start AS start_us, least(max(t) + 21600000000, start + 28800000000) AS end_us, count(*) AS events, CAST(part AS INTEGER) AS part FROM walk GROUP BY user_id, start, part""")
def _(t: Tables):
    s = streamed(t)
    return s.run(jobs.sessions(s.events.select("user_id", "ts", us("ts").alias("ts_us"), "event_id"), idle=360), "sessions")


@query("st10_session_stream", CONSISTENCY.replace(", count(*) AS changes", ""))
def _(t: Tables):
    s = streamed(t)
    return s.run(jobs.consistency_stream(session_activity(s.events)), "consistency")


@query("st08_audit_fanout", with_alerts(AUDIT + """SELECT 'audit' AS sink, event_id FROM audit UNION ALL SELECT 'compliance', event_id FROM audit WHERE tags <> ''
UNION ALL SELECT 'security', event_id FROM audit WHERE risk_score >= 0.7e0 OR severity = 'critical'"""))
def _(t: Tables):
    root = scratch_dir(t.spark, "fanout")
    jobs.audit_fanout(audit(streamed(t)), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    out = None
    for name in ("audit", "compliance", "security"):
        rows = t.spark.read.parquet(f"{root}/out/{name}").select(F.lit(name).alias("sink"), "event_id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("st09_issue_upsert", with_alerts("""
i AS (SELECT substr(sha256(title), 1, 10) AS issue_id, title, ts, full_log FROM (SELECT *, rule_desc || ' on ' || agent_name AS title FROM alerts) a)
SELECT issue_id, arg_min(title, (ts, full_log)) AS title, epoch_us(min(ts)) AS ts_us, arg_min(full_log, (ts, full_log)) AS summary
FROM i WHERE issue_id NOT IN (SELECT substr(sha256('error on host-' || x), 1, 10) FROM range(5) r(x)) GROUP BY 1"""))
def _(t: Tables):
    root = scratch_dir(t.spark, "issues")
    title = F.concat("rule_desc", F.lit(" on "), "agent_name")
    detected = t.alerts.select("ts", F.lit("medium").alias("severity"), title.alias("title"), F.col("full_log").alias("summary"), F.lit("operational").alias("category"))
    third = t.events.select(F.percentile_approx(F.unix_seconds(F.col("ts").cast("timestamp")), [1 / 3, 2 / 3], 100).alias("b")).first()["b"]
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    bounds = [at < third[0], (at >= third[0]) & (at < third[1]), at >= third[1]] if third else [F.lit(True)]
    ignored = t.spark.range(5).select(iss.issue_id(F.concat(F.lit("error on host-"), "id")).alias("issue_id"))
    for part in bounds:  # three parts, in the order of their times; each is a batch of the same resumed stream
        detected.where(part).write.mode("append").parquet(f"{root}/in")
        stream = t.spark.readStream.schema(detected.schema).parquet(f"{root}/in")
        jobs.issue_upsert(stream, f"{root}/table", f"{root}/checkpoint", ignored).awaitTermination()
    return jobs.read_issues(t.spark, f"{root}/table").select("issue_id", "title", us("ts").alias("ts_us"), "summary")
