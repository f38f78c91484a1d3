"""Structured Streaming forms of ingest, deduplication, counts, rates and fan-out.

Every builder returns a streaming DataFrame or starts a query from one; the
caller chooses source, trigger and checkpoint folder. Event time everywhere.
Limits, lockouts and sessions see the rows of a key in event time (``ordered``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from alertloom import config
from alertloom.operators import audit as au
from alertloom.sources.alerts import ALERT_SCHEMA
from alertloom.streaming import ordered


def read_alert_stream(spark: SparkSession, path: str, schema: str = ALERT_SCHEMA, max_files: int = 1000) -> DataFrame:
    """JSON lines that arrive as files; a rotated log is simply a new file."""
    return (spark.readStream.schema(f"{schema}, _bad STRING").option("maxFilesPerTrigger", max_files)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path))


def ingest(stream: DataFrame, out: str, quarantine: str, checkpoint: str) -> StreamingQuery:
    """Good lines to ``out``, undecodable lines to ``quarantine``, offsets in the checkpoint."""

    def split(batch: DataFrame, batch_id: int) -> None:
        # A replayed batch overwrites its own folder, so a retry adds nothing twice. The lines are parsed once.
        batch.persist()
        batch.where("_bad IS NULL").drop("_bad").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        batch.where("_bad IS NOT NULL").select(F.col("_bad").alias("line")).write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")
        batch.unpersist()

    return (stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def dedup_stream(logs: DataFrame, ts: str = "ts", key: str = "sha256", delay: str = "1 hour") -> DataFrame:
    """Each content hash once within the watermark."""
    return logs.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def minute_counts(logs: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Alerts per minute of event time."""
    return logs.withWatermark(ts, delay).groupBy(F.window(ts, "1 minute")).agg(F.count("*").alias("n"))


def sliding_rates(events: DataFrame, seconds: int, step: int, limit: int, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Kinds whose count in a sliding window reaches the limit."""
    return (events.withWatermark(ts, delay).groupBy("kind", F.window(ts, f"{seconds} seconds", f"{step} seconds"))
            .agg(F.count("*").alias("n")).where(F.col("n") >= limit))


def sessions(activity: DataFrame, ts: str = "ts", key: str = "user_id", idle: int = config.SESSION_IDLE_MINUTES,
             hours: int = config.SESSION_ABSOLUTE_HOURS, delay: str = "2 hours") -> DataFrame:
    """Parts of sessions (key, start_us, end_us, events, part): the idle limit ends a session, the absolute limit begins its next part.

    ``activity``: the key, the event time, ts_us and event_id.
    """
    step = ordered.session_parts(idle * 60_000_000, hours * 3_600_000_000)
    out = [(key, dict(activity.dtypes)[key]), ("start_us", "bigint"), ("end_us", "bigint"), ("events", "bigint"), ("part", "int")]
    return ordered.in_order(activity, key, ["ts_us", "event_id"], "start_us bigint, last_us bigint, events bigint, part int", out, step, delay, ts)


def rate_limit_stream(requests: DataFrame, limit: int = config.REQUESTS_PER_MINUTE, window_s: int = 60, burst: int = config.BURST_LIMIT,
                      burst_s: int = config.BURST_SECONDS, max_violations: int = config.MAX_VIOLATIONS, delay: str = "10 minutes") -> DataFrame:
    """Verdict per request, in event time: pass, limited, or blocked once an ip has more than ``max_violations``.

    ``requests``: request_id, ip, ts, ts_us. State holds at most ``limit`` times and the violations of an ip; an ip
    without violations is forgotten after a quiet window, a block stays.
    """
    step = ordered.limiter(limit, window_s * 1_000_000, burst, burst_s * 1_000_000, max_violations)
    kinds = dict(requests.dtypes)
    out = [("request_id", kinds["request_id"]), ("ip", kinds["ip"]), ("ts_us", "bigint"), ("verdict", "string"), ("violations", "bigint")]
    return ordered.in_order(requests, "ip", ["ts_us", "request_id"], "times array<bigint>, violations bigint", out, step, delay)


def lockout_stream(failures: DataFrame, minutes: int = config.LOCKOUT_MINUTES, limit: int = config.LOCKOUT_FAILURES,
                   delay: str = "10 minutes") -> DataFrame:
    """Moments (user_id, ts_us) at which the trailing failures of a user reach the limit, in event time.

    ``failures``: user_id, ts, ts_us, event_id. State holds the newest ``limit`` times of a user.
    """
    out = [("user_id", dict(failures.dtypes)["user_id"]), ("ts_us", "bigint")]
    return ordered.in_order(failures, "user_id", ["ts_us", "event_id"], "times array<bigint>", out, ordered.lockout(minutes * 60_000_000, limit), delay)


def consistency_stream(activity: DataFrame, keep_hours: int = 24, delay: str = "10 minutes") -> DataFrame:
    """The first change of address or agent of each session (session_id, closed_us, reason), as soon as the watermark has passed it.

    ``activity``: session_id, ts, ts_us, event_id, ip, user_agent. A session is forgotten ``keep_hours`` after its last event.
    """
    out = [("session_id", dict(activity.dtypes)["session_id"]), ("closed_us", "bigint"), ("reason", "string")]
    return ordered.in_order(activity, "session_id", ["ts_us", "event_id", "ip", "user_agent"], "ip string, user_agent string, closed boolean, last_us bigint", out,
                            ordered.consistency(keep_hours * 3_600_000_000), delay)


def audit_fanout(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Every batch to the three audit sinks."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for name, part in au.audit_sinks(batch).items():
            part.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
        batch.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def issue_upsert(issues: DataFrame, table: str, checkpoint: str, ignored: DataFrame | None = None) -> StreamingQuery:
    """Adds each batch of detected issues to the issue table.

    A detected issue is new when no stored issue has its signature or id and its id is not in ``ignored`` (issue_id); of
    several with one signature or id in a batch the earliest counts. ``issues``: ts, severity, title, summary, category. Every
    batch overwrites its own folder of ``table`` and is judged by the folders before it, so a replayed batch adds
    nothing and the table is never rewritten.
    """
    from alertloom.operators.issues import new_issues, signature

    columns = ["issue_id", "ts", "severity", "title", "summary", "category"]

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = _issue_folders(spark, table).where(F.col("batch") < batch_id)
        listed = ignored if ignored is not None else spark.createDataFrame([], "issue_id string")
        detected = batch.withColumn("ord", F.struct("ts", "title", "summary", "severity"))
        fresh = new_issues(detected, known, listed).select(*columns, signature(F.col("severity"), F.col("title"), F.col("summary")).alias("signature"))
        fresh.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
    return issues.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _issue_folders(spark: SparkSession, table: str) -> DataFrame:
    from alertloom.sources.stores import read_or_empty

    empty = spark.createDataFrame([], "issue_id string, ts timestamp, severity string, title string, summary string, category string, signature string, batch int")
    return read_or_empty(spark, table, empty)


def read_issues(spark: SparkSession, table: str, cap: int | None = None) -> DataFrame:
    """The issues that ``issue_upsert`` has stored, all or the ``cap`` newest."""
    issues = _issue_folders(spark, table).drop("batch")
    return issues if cap is None else issues.orderBy(F.col("ts").desc(), "issue_id").limit(cap)


def with_heartbeats(stream: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """``stream`` and the rows that ``heartbeat`` writes to ``folder``, which only move the event time on."""
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))


def heartbeat(spark: SparkSession, schema, folder: str, at: str, ts: str = "ts") -> None:
    """A row of nulls at the time ``at``: a source that has gone quiet closes its windows, timers and sessions up to then."""
    from pyspark.sql.types import StructField, StructType

    loose = StructType([StructField(f.name, f.dataType, True) for f in schema])
    row = spark.createDataFrame([tuple(None for _ in loose)], loose).withColumn(ts, F.lit(at).cast(loose[ts].dataType))
    row.coalesce(1).write.mode("append").parquet(folder)


def run_to_table(stream: DataFrame, spark: SparkSession, label: str, mode: str = "append", then=None) -> DataFrame:
    """Run a stream over all available input into parquet and read the result.

    ``then``, a function without arguments, may add input (a heartbeat, say); the stream is then resumed from its checkpoint.
    """
    from alertloom.session import scratch_dir

    root = scratch_dir(spark, label)
    provider = spark.conf.get(ordered.PROVIDER)
    spark.conf.set(ordered.PROVIDER, ordered.ROCKSDB)  # a query keeps the store it was started with
    try:
        for last in ([False, True] if then else [True]):
            (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{root}/out")
             .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination())
            if not last:
                then()
    finally:
        spark.conf.set(ordered.PROVIDER, provider)
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
