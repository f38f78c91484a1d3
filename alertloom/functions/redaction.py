"""Replacement texts and the application of hits to a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertloom import config
from alertloom.functions import pii


ACTIONS = ("array<struct<order:int,size:int,start:int,len:int,kind:string,source:string,replacement:string>>")


def tokenize(kind: Column, value: Column, salt: str = config.DEFAULT_SALT) -> Column:
    """``TYPE_TOKEN_`` and eight hex digits; equal values give equal tokens."""
    return F.concat(F.upper(kind), F.lit("_TOKEN_"), F.upper(F.substring(F.md5(F.concat(value, F.lit(salt))), 1, 8)))


def mask(value: Column, keep_format: bool = True) -> Column:
    """Mask a value; with ``keep_format`` its shape stays recognisable."""
    n = F.length(value)
    stars = lambda count: F.repeat(F.lit("*"), count)
    if not keep_format:
        return stars(F.least(n, F.lit(8)))
    plain = F.regexp_replace(value, r"[\s-]", "")
    local, domain = F.split_part(value, F.lit("@"), F.lit(1)), F.regexp_extract(value, "^[^@]*@(.*)$", 1)
    hidden = F.when(F.length(local) > 2, F.concat(F.left(local, F.lit(1)), stars(F.length(local) - 2), F.right(local, F.lit(1)))
                    ).otherwise(stars(F.length(local)))
    return (
        F.when(value.rlike(r"^\d{3}-\d{2}-\d{4}"), "***-**-****")
        .when(value.rlike(r"^\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}"),
              F.concat(F.left(plain, F.lit(4)), F.lit("-****-****-"), F.right(plain, F.lit(4))))
        .when(value.rlike(r"^\d{3}-\d{3}-\d{4}"), "***-***-****")
        .when(value.rlike(r"^\(\d{3}\)\s?\d{3}-\d{4}"), "(***) ***-****")
        .when(value.contains("@"), F.concat(hidden, F.lit("@"), domain))
        .when(n <= 2, stars(n))
        .when(n <= 4, F.concat(F.left(value, F.lit(1)), stars(n - 2), F.right(value, F.lit(1))))
        .otherwise(F.concat(F.left(value, F.lit(2)), stars(n - 4), F.right(value, F.lit(2))))
    )


def hashed(kind: Column, value: Column, salt: str = config.DEFAULT_SALT) -> Column:
    digest = F.sha2(F.concat(value, F.lit(salt), kind), 256)
    return F.concat(F.upper(kind), F.lit("_HASH_"), F.upper(F.substring(digest, 1, 16)))


def replacement(strategy: str, kind: Column, value: Column, keep_format: bool = True,
                salt: str = config.DEFAULT_SALT) -> Column:
    """Replacement text of one strategy."""
    if strategy == "mask":
        return mask(value, keep_format)
    if strategy == "hash":
        return hashed(kind, value, salt)
    if strategy == "remove":
        return F.lit("[REDACTED]")
    if strategy == "anonymize":
        return F.concat(F.lit("[ANONYMIZED_"), F.upper(kind), F.lit("]"))
    if strategy == "preserve":
        return value
    return tokenize(kind, value, salt)


def rule_minimum(kind: Column, rules: dict, aggressive: bool) -> Column:
    result = F.lit(config.REDACTION_DEFAULT[2])
    for name, (_, _, minimum) in rules.items():
        result = F.when(kind == name, minimum).otherwise(result)
    return F.least(result, F.lit(config.AGGRESSIVE_MINIMUM)) if aggressive else result


def rule_replacement(kind: Column, value: Column, rules: dict, salt: str) -> Column:
    strategy, keep, _ = config.REDACTION_DEFAULT
    result = replacement(strategy, kind, value, keep, salt)
    for name, (strategy, keep, _) in rules.items():
        result = F.when(kind == name, replacement(strategy, kind, value, keep, salt)).otherwise(result)
    return result


def redaction_actions(text: Column, mode: str = "embedding", rules: dict | None = None,
                      salt: str = config.DEFAULT_SALT, threats: Column | None = None) -> Column:
    """Non-overlapping replacements of a text, ordered by position.

    Indicators that ``threats`` lists (see ``pii.with_threats``) stay readable.

    Indicators come before personal data, then the longer, then the earlier
    hit; a hit that overlaps an accepted one is dropped.
    """
    rules = {**config.REDACTION_RULES, **(rules or {})}
    keep_indicators, aggressive, _, _ = config.REDACTION_MODES[mode]
    minimum = config.AGGRESSIVE_MINIMUM if aggressive else config.PII_KEEP
    personal = F.filter(pii.drop_false_positives(pii.pii_candidates(text, minimum=minimum)),
                        lambda h: h["confidence"] >= rule_minimum(h["kind"], rules, aggressive))
    action = lambda h, order, source, new: F.struct(
        F.lit(order).alias("order"), (-h["len"]).alias("size"), h["start"].alias("start"), h["len"].alias("len"),
        h["kind"].alias("kind"), F.lit(source).alias("source"), new.alias("replacement"))
    actions = F.transform(personal, lambda h: action(h, 1, "pii", rule_replacement(h["kind"], h["value"], rules, salt)))
    if keep_indicators:
        listed = (lambda h: h["listed"]) if threats is not None else (lambda h: None)
        kept = F.transform(pii.detect_indicators(text, threats=threats), lambda h: action(h, 0, "indicator", F.when(
            pii.keep_original(h["kind"], h["value"], listed=listed(h)), h["value"]).otherwise(pii.indicator_token(h["kind"], h["value"]))))
        actions = F.concat(kept, actions)
    ranked = F.array_sort(actions)
    apart = lambda a, b: (a["start"] + a["len"] <= b["start"]) | (b["start"] + b["len"] <= a["start"])
    accepted = F.aggregate(
        ranked, F.array().cast(ACTIONS),
        lambda acc, h: F.when(F.forall(acc, lambda a: apart(a, h)), F.array_append(acc, h)).otherwise(acc))
    return F.array_sort(F.transform(accepted, lambda h: F.struct(
        h["start"].alias("start"), h["len"].alias("len"), h["kind"].alias("kind"), h["source"].alias("source"),
        h["replacement"].alias("replacement"))))


def apply_actions(text: Column, actions: Column) -> Column:
    """The text with every action applied; pieces are cut from the original text."""
    done = F.aggregate(
        actions, F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out")),
        lambda acc, a: F.struct(
            (a["start"] + a["len"]).alias("pos"),
            F.concat(acc["out"], F.array(F.substring(text, acc["pos"] + 1, a["start"] - acc["pos"]), a["replacement"])).alias("out")),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["pos"] + 1, F.length(text))))
    return F.when(F.size(actions) == 0, text).otherwise(done)
