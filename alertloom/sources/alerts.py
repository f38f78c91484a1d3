"""Reading alert rows: JSON lines, raw rows, and the event log seen as alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom import config

ALERT_SCHEMA = (
    "timestamp STRING, rule STRUCT<id: STRING, description: STRING, level: INT, groups: ARRAY<STRING>>, "
    "agent STRUCT<name: STRING>, location STRING, data MAP<STRING, STRING>, full_log STRING"
)


def alerts_from_events(events: DataFrame) -> DataFrame:
    """The alert view of a generic event log (one alert per event)."""
    kind = F.col("event_type")

    def by_kind(view, click, signup, purchase, other):
        return (F.when(kind == "view", view).when(kind == "click", click).when(kind == "signup", signup)
                .when(kind == "purchase", purchase).otherwise(other))

    base = events.select(
        F.col("event_id").alias("alert_id"),
        "ts",
        by_kind("1001", "1002", "1003", "1004", "1005").alias("rule_id"),
        kind.alias("rule_desc"),
        F.least(F.lit(15), F.floor(F.col("value") / 10).cast("int")).alias("rule_level"),
        F.concat(F.lit("host-"), F.col("user_id") % 25).alias("agent_name"),
        F.concat(F.lit("user_"), F.col("user_id")).alias("src_user"),
        F.concat(F.lit("10.0."), F.floor(F.col("user_id") / 16), F.lit("."), F.col("user_id") % 250).alias("src_ip"),
        F.when(kind == "error", "FAILURE").otherwise("SUCCESS").alias("outcome"),
        by_kind("file access", "network connection", "login attempt", "process execution",
                "authentication failed").alias("phrase"),
        F.sha2(F.concat_ws("|", F.col("event_id"), kind, F.col("user_id")), 256).alias("sha256"),
    )
    return base.select(
        "alert_id", "ts", "rule_id", "rule_desc", "rule_level", "agent_name",
        F.concat("agent_name", F.lit("->/var/log/"), "rule_desc", F.lit(".log")).alias("location"),
        "src_user", "src_ip", "outcome",
        F.concat("phrase", F.lit(" for "), "src_user", F.lit(" from "), "src_ip", F.lit(" on "),
                 "agent_name").alias("full_log"),
        "sha256",
    )


def read_json_lines(spark: SparkSession, path: str, schema: str = ALERT_SCHEMA) -> DataFrame:
    """JSON lines with a ``_bad`` column that holds undecodable lines."""
    return (
        spark.read.schema(f"{schema}, _bad STRING")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad")
        .json(path)
    )


def split_corrupt(rows: DataFrame, bad: str = "_bad") -> tuple[DataFrame, DataFrame]:
    """(good rows without the marker column, quarantined lines)."""
    good = rows.where(F.col(bad).isNull()).drop(bad)
    quarantine = rows.where(F.col(bad).isNotNull()).select(F.col(bad).alias("line"))
    return good, quarantine


def decode_lines(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """Decode a column of JSON text: ``parsed`` is null where the text is not JSON."""
    valid = F.try_parse_json(F.col(column)).isNotNull()
    return lines.withColumn("parsed", F.when(valid, F.from_json(F.col(column), schema)))


def newest(alerts: DataFrame, n: int = config.INITIAL_SCAN_ROWS, ts: str = "ts", tie: str = "alert_id") -> DataFrame:
    """The ``n`` most recent rows: a bounded per-partition heap, then one merge."""
    return alerts.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


def content_hash(*columns: str) -> Column:
    """SHA-256 of the row as JSON with its keys in alphabetical order."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def escape_angles(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def lookup(logs: DataFrame, sha: str, key: str = "sha256") -> DataFrame:
    """Point lookup by content hash; text columns come back angle-escaped."""
    row = logs.where(F.col(key) == sha)
    return row.select(*[
        escape_angles(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name)
        for f in logs.schema.fields
    ])
