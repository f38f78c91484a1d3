"""Registration of named queries over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from alertloom.sources.alerts import alerts_from_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class Tables:
    """Lazy access to the parquet tables of one scale folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        # Day and hour functions must not depend on where the driver runs.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def alerts(self) -> DataFrame:
        return alerts_from_events(self.events)


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables)`` as a query, with its SQL twin where there is one."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


# The alert view in SQL; the Spark form is sources.alerts.alerts_from_events.
ALERTS = """alerts AS (
  SELECT alert_id, ts, rule_id, rule_desc, rule_level, agent_name,
         agent_name || '->/var/log/' || rule_desc || '.log' AS location,
         src_user, src_ip, outcome,
         phrase || ' for ' || src_user || ' from ' || src_ip || ' on ' || agent_name AS full_log,
         sha256
  FROM (
    SELECT event_id AS alert_id, ts, event_type AS rule_desc,
           CASE event_type WHEN 'view' THEN '1001' WHEN 'click' THEN '1002' WHEN 'signup' THEN '1003'
                WHEN 'purchase' THEN '1004' ELSE '1005' END AS rule_id,
           least(15, CAST(floor(value / 10) AS INTEGER)) AS rule_level,
           'host-' || (user_id % 25) AS agent_name,
           'user_' || user_id AS src_user,
           '10.0.' || CAST(floor(user_id / 16) AS BIGINT) || '.' || (user_id % 250) AS src_ip,
           CASE WHEN event_type = 'error' THEN 'FAILURE' ELSE 'SUCCESS' END AS outcome,
           CASE event_type WHEN 'error' THEN 'authentication failed' WHEN 'signup' THEN 'login attempt'
                WHEN 'view' THEN 'file access' WHEN 'click' THEN 'network connection'
                ELSE 'process execution' END AS phrase,
           sha256(event_id || '|' || event_type || '|' || user_id) AS sha256
    FROM events) e
)"""


def with_alerts(rest: str) -> str:
    """``rest`` (further CTEs and the final select, or just a select) over alerts."""
    rest = rest.strip()
    joiner = "\n" if rest[:6].upper() == "SELECT" else ",\n"
    return "WITH " + ALERTS + joiner + rest
