"""Audit events: severity, risk, routing and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom import config


def audit_fields(kind: Column, outcome: Column, has_pii: Column, status: Column) -> list[Column]:
    """Outcome, severity and compliance tags of an event by its kind."""
    failed = outcome == "FAILURE"
    result = (F.when(kind == "api_access", F.when((status >= 200) & (status < 400), "SUCCESS").otherwise("FAILURE"))
              .when(kind == "security_violation", "DETECTED").when(kind == "system_error", "FAILURE")
              .when(kind.isin("authentication", "authorization"), outcome).otherwise("SUCCESS"))
    severity = (F.when(kind == "authentication", F.when(failed, "high").otherwise("medium"))
                .when(kind == "authorization", F.when(failed, "high").otherwise("low"))
                .when(kind == "data_access", F.when(has_pii, "high").otherwise("medium"))
                .when(kind == "api_access", F.when(status >= 400, "high").otherwise("low"))
                .when(kind == "security_violation", "critical").when(kind == "configuration_change", "medium")
                .when(kind.isin("pii_detection", "system_error"), "high")
                .when(kind == "content_redaction", F.when(has_pii, "high").otherwise("low")).otherwise("low"))
    tags = (F.when(kind == "pii_detection", F.array(F.lit("GDPR"), F.lit("HIPAA"), F.lit("PCI-DSS")))
            .when(kind.isin("data_access", "content_redaction") & has_pii, F.array(F.lit("GDPR"), F.lit("HIPAA")))
            .otherwise(F.array().cast("array<string>")))
    return [result.alias("outcome"), severity.alias("severity"), tags.alias("compliance_tags")]


def risk_score(kind: Column, outcome: Column, severity: Column) -> Column:
    """Base risk by kind, raised by outcome and severity, at most 1."""
    # Map look-ups name each input once; nested conditions would multiply the
    # expression whenever a filter on the score is pushed below it.
    table = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    base = F.coalesce(table(config.AUDIT_BASE_RISK)[kind], F.lit(config.AUDIT_OTHER_RISK))
    factor = F.coalesce(table(config.AUDIT_OUTCOME_FACTOR)[outcome], F.lit(1.0))
    weight = F.coalesce(table(config.AUDIT_SEVERITY_FACTOR)[severity], F.lit(1.0))
    # violations are logged with a fixed risk
    return F.when(kind == "security_violation", 0.9).otherwise(F.least(base * factor * weight, F.lit(1.0)))


def with_risk(events: DataFrame) -> DataFrame:
    return events.withColumn("risk_score", risk_score(F.col("kind"), F.col("outcome"), F.col("severity")))


COMPLIANCE = ["event_id", "ts_us", "compliance_tags", "action", "outcome", "user_id", "details"]
SECURITY = ["event_id", "ts_us", "kind", "severity", "risk_score", "action", "outcome", "user_id", "source_ip", "details"]


def audit_sinks(events: DataFrame) -> dict[str, DataFrame]:
    """Three filtered projections: everything, tagged events, risky events."""
    return {
        "audit": events,
        "compliance": events.where(F.size("compliance_tags") > 0).select(*COMPLIANCE),
        "security": events.where((F.col("risk_score") >= config.AUDIT_HIGH_RISK) | (F.col("severity") == "critical")).select(*SECURITY),
    }


def audit_metrics(events: DataFrame) -> DataFrame:
    """Totals by kind, by severity and overall, in one pass."""
    grouped = events.groupingSets([["kind"], ["severity"], []], "kind", "severity").agg(
        F.count("*").alias("events"),
        F.count_if((F.col("kind") == "authentication") & (F.col("outcome") == "FAILURE")).alias("failed_logins"),
        F.count_if(F.col("risk_score") >= config.AUDIT_HIGH_RISK).alias("high_risk"),
        F.count_if(F.size("compliance_tags") > 0).alias("tagged"))
    return grouped.select(F.coalesce("kind", F.lit("all")).alias("kind"), F.coalesce("severity", F.lit("all")).alias("severity"),
                          "events", "failed_logins", "high_risk", "tagged")


def rate_kinds(events: DataFrame) -> DataFrame:
    """(kind, ts_us) rows for the rate limits an event counts towards."""
    hit = lambda cond, name: F.when(cond, F.lit(name))
    kinds = F.array_compact(F.array(
        hit((F.col("kind") == "authentication") & (F.col("outcome") == "FAILURE"), "failed_auth"),
        hit(F.col("kind") == "pii_detection", "pii_detection"),
        hit(F.col("risk_score") >= config.AUDIT_HIGH_RISK, "high_risk"),
        hit((F.col("kind") == "api_access") & (F.col("outcome") == "FAILURE"), "api_error")))
    return events.select(F.explode(kinds).alias("kind"), "ts_us")
