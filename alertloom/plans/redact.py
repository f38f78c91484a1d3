"""Redaction jobs: text in, safe text and audit rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom import config
from alertloom.functions import pii, redaction
from alertloom.functions.matching import exploded, words
from alertloom.operators import lookup
from alertloom.session import cut_lineage, spread


HIT = [f"h.{c}" for c in ("kind", "value", "start", "len", "context", "confidence")]


def pii_hits(docs: DataFrame, key: str = "doc_id", text: str = "text", custom=None) -> DataFrame:
    """One row per personal data hit."""
    found = exploded(spread(docs.select(key, text)), [key], pii.detect_pii(F.col(text), custom), "h")
    return found.select(key, *HIT)


def pii_candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", minimum: float = 0.0) -> DataFrame:
    found = exploded(spread(docs.select(key, text)), [key], pii.pii_candidates(F.col(text), minimum=minimum), "h")
    return found.select(key, *HIT)


def indicator_hits(docs: DataFrame, key: str = "doc_id", text: str = "text", candidates: bool = False) -> DataFrame:
    """One row per security indicator hit."""
    hits = (pii.indicator_candidates if candidates else pii.detect_indicators)(F.col(text))
    return exploded(spread(docs.select(key, text)), [key], hits, "h").select(key, *HIT)


def text_threats(docs: DataFrame, intel: DataFrame, key: str = "doc_id", text: str = "text", hits: DataFrame | None = None) -> DataFrame:
    """``key, threats``: the listed indicator values of each text that has some.

    Hits are looked up without their texts; a list is no longer than the different hits of its texts. ``hits``: the
    indicator candidates of the texts where a caller has written them; else the texts are searched here.
    """
    kinds = list(config.THREAT_BOOST)
    hits = indicator_hits(docs, key, text, candidates=True) if hits is None else hits
    hits = hits.where(F.col("kind").isin(kinds)).select(key, "kind", F.lower("value").alias("value")).distinct()
    hits = cut_lineage(hits, "hits")  # looked up and joined: the texts are searched once
    listed = hits.join(lookup.listed_values(hits, intel).select("kind", "value"), ["kind", "value"])
    return listed.groupBy(key).agg(F.sort_array(F.collect_set(pii.threat_key(F.col("kind"), F.col("value")))).alias("threats"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", mode: str = "embedding", rules=None,
           salt: str = config.DEFAULT_SALT, intel: DataFrame | None = None, hits: DataFrame | None = None) -> DataFrame:
    """Redacted text per row with its statistics. Narrow: no shuffle.

    With a threat table ``intel`` (``kind, value``) listed indicators stay readable
    and gain confidence; the texts then meet their lists in one join on ``key``.
    ``hits`` is as in ``text_threats``.
    """
    rows, threats = docs.select(key, text), None
    if intel is not None:
        lists = text_threats(rows, intel, key, text, hits).withColumnRenamed(key, "threats_of")
        rows = rows.join(lists, F.col(key).eqNullSafe(F.col("threats_of")), "left")
        threats = F.col("threats")
    acted = spread(rows).withColumn("actions", redaction.redaction_actions(F.col(text), mode, rules, salt, threats))
    n = F.size(F.filter("actions", lambda a: a["source"] == "pii"))
    return acted.withColumn("redacted", redaction.apply_actions(F.col(text), F.col("actions"))).select(
        key, "redacted", n.alias("redactions"),
        F.size(F.filter("actions", lambda a: a["source"] == "indicator")).alias("indicators"),
        F.length(text).alias("length_before"), F.length("redacted").alias("length_after"),
        # words are counted only where something was redacted; a null text stays null
        F.when(n == 0, 0.0).otherwise(n / F.greatest(F.size(words(F.col(text))), F.lit(1))).alias("ratio"))


def export_redacted(rows: DataFrame, mode: str = "export", rules=None, salt: str = config.DEFAULT_SALT) -> DataFrame:
    """Every string column of a row redacted, other columns unchanged."""
    out = []
    for field in rows.schema.fields:
        if field.dataType.simpleString() == "string":
            actions = redaction.redaction_actions(F.col(field.name), mode, rules, salt)
            out.append(redaction.apply_actions(F.col(field.name), actions).alias(field.name))
        else:
            out.append(F.col(field.name))
    return spread(rows).select(*out)


def processing_audit(docs: DataFrame, mode: str = "embedding", key: str = "doc_id", text: str = "text") -> DataFrame:
    """One audit row per processed text."""
    counted = spread(docs.select(key, text)).select(
        key, F.substring(F.sha2(F.col(text), 256), 1, 16).alias("content_hash"),
        F.size(pii.detect_pii(F.col(text))).alias("pii_detected"),
        F.size(pii.detect_indicators(F.col(text))).alias("entities_preserved"))
    found = F.col("pii_detected") > 0
    return counted.select(
        "*", F.lit(mode).alias("processing_mode"), F.lit("content_redaction").alias("event_type"),
        F.lit("content_processing").alias("action"), F.lit("SUCCESS").alias("outcome"),
        F.when(found, "high").otherwise("low").alias("severity"),
        F.when(found, F.array(F.lit("GDPR"), F.lit("HIPAA"))).otherwise(F.array().cast("array<string>")).alias("compliance_tags"))
