"""Personal data and security indicator hits as array expressions.

One narrow stage per text: each hit is a struct in an array column, scored and
filtered in place. Nothing is exploded or shuffled before a caller asks for
one row per hit.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertloom import config
from alertloom.functions.addresses import STRICT_IPV4, ip_number, ipv6_digits, let  # noqa: F401
from alertloom.functions.matching import contains_any, context_of, find_all

def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[\s-]", "")


def luhn_valid(value: Column) -> Column:
    """Luhn check over the digits of a card number."""
    # Each digit on its own contributes the same amount wherever it stands, so
    # the sum is taken over places counted from the right.
    digits = F.split(F.reverse(_digits(value)), "")
    numbers = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.when(
        i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") < 5, d.cast("int") * 2).otherwise(d.cast("int") * 2 - 9)))
    total = F.aggregate(numbers, F.lit(0), lambda acc, x: acc + x)
    return _digits(value).rlike(r"^\d+$") & (total % 10 == 0)


def pii_confidence(kind: str, value: Column, low: Column) -> Column:
    """Confidence of one hit from its form and the lower-cased text around it."""
    if kind == "ssn":
        area = F.substring(_digits(value), 1, 3).cast("int")
        base = F.when(area.between(1, 899) & (area != 666), 0.95).otherwise(0.6)
    elif kind == "credit_card":
        base = F.when(luhn_valid(value), 0.95).otherwise(0.5)
    elif kind == "email":
        base = F.lit(0.9)
    else:
        base = F.lit(0.8)
    damped = F.when(contains_any(low, config.PII_LOG_WORDS), base * 0.9).otherwise(base)
    return F.when(contains_any(low, config.PII_PERSONAL_WORDS), F.least(damped * 1.1, F.lit(1.0))).otherwise(damped)


def pii_false_positive(kind: Column, value: Column, low: Column) -> Column:
    """Likely false positives: known words by type, example contexts, test values."""
    low_value = F.lower(value)
    false = contains_any(low, config.PII_FALSE_CONTEXT)
    for name, words in config.PII_FALSE_WORDS.items():
        false = false | ((kind == name) & (contains_any(low, words) | contains_any(low_value, words)))
    false = false | ((kind == "ssn") & _digits(value).isin(config.PII_FALSE_SSN))
    return false | ((kind == "email") & contains_any(low_value, config.PII_TEST_DOMAINS))


# Cheap necessary conditions per kind, as in functions.entities. A plain substring is found in the bytes of a
# text; a pattern first decodes it, so most texts should need few of them.
has = lambda *parts: lambda text: contains_any(text, list(parts))
match = lambda pattern: lambda text: text.rlike(pattern)

PII_GATES = {"ssn": match(r"\d{3}[\s-]?\d{2}"), "credit_card": match(r"\d{4}[\s-]?\d{4}"), "email": has("@"),
             "phone": match(r"\d{3}[\s.-]?\d{4}"), "name": match(r"[A-Z][a-z]+\s+[A-Z](?:[a-z]|\.\s)"),
             "address": match(r"\d\s"), "date_of_birth": match(r"\d{4}")}
# The classes of the first letters are tested before the border of a word, which is dear at every place of a text.
PROTOCOL_GATE = "(?=[DFHIPSTUdfhipstu][CDEHMNOPSTcdehmnopst][ABCHLMPSTabchlmpst])" + dict(config.INDICATOR_PATTERNS)["protocol"]
INDICATOR_GATES = {"ip_address": lambda text: text.rlike(r"\d\.\d+\.\d") | (text.contains(":") & text.rlike("[0-9a-fA-F]:[0-9a-fA-F]")),
                   "domain": match(r"\.[a-zA-Z]{2}"), "file_hash": match("[a-fA-F0-9]{32}"), "port": has(":", "port", "Port", "PORT"),
                   "protocol": match(PROTOCOL_GATE), "process_name": has(".e", ".E", ".d", ".D", "bin/"), "cve": has("e-", "E-"),
                   "signature_id": match(r"[DdEe][\s:=]+\d"), "event_id": match(r"[Dd][\s:=]+\d")}
# The kinds that need no digit anywhere in a text.
WITHOUT_DIGIT = ("email", "name", "ip_address", "domain", "file_hash", "protocol", "process_name")


def gated(text: Column, gates: dict[str, Callable], patterns: list[tuple[str, str]], hits: Callable[[str, str], Column]) -> Column:
    """Hits of all patterns; the patterns of a kind run only where its gate matches.

    Most kinds need a digit and most texts of prose have none: one test then settles all of those kinds.
    """
    empty = F.array().cast("array<struct<kind:string,value:string,start:int,len:int,context:string,low:string,confidence:double>>")

    def found(digit: Column, kind: str) -> Column:
        test = gates[kind](text) if kind in WITHOUT_DIGIT else digit & gates[kind](text)
        return F.when(test, F.concat(*[hits(k, p) for k, p in patterns if k == kind])).otherwise(empty)

    return let(text.rlike("[0-9]"), lambda digit: F.concat(*[found(digit, kind) for kind in dict.fromkeys(k for k, _ in patterns)]))


def located(text: Column, pattern: str, width: int, extra: int = 0) -> Column:
    """Matches with their context, lower-cased context and, optionally, a wider one.

    The contexts are cut in a step of their own: inside a lambda nothing is
    shared, so a later step that tests twenty words must find the short lower
    case text in the struct and not cut it from the whole text twenty times.
    """
    def cut(h):
        context = context_of(text, h, width)
        fields = [h["value"].alias("value"), h["start"].alias("start"), h["len"].alias("len"),
                  context.alias("context"), F.lower(context).alias("low")]
        return F.struct(*fields, *([F.lower(context_of(text, h, extra)).alias("wide")] if extra else []))

    return F.transform(find_all(text, pattern), cut)


def _scored(hits: Column, kind: str, confidence: Callable[[Column, Column], Column]) -> Column:
    """Located matches as scored hits of one kind."""
    return F.transform(hits, lambda h: F.struct(
        F.lit(kind).alias("kind"), h["value"].alias("value"), h["start"].alias("start"), h["len"].alias("len"),
        h["context"].alias("context"), h["low"].alias("low"), confidence(h["value"], h["low"]).alias("confidence")))


def _fixed(confidence: float, value: Column, low: Column) -> Column:
    return F.lit(confidence)


def pii_candidates(text: Column, custom: list[tuple[str, str, float]] | None = None,
                   minimum: float = config.PII_KEEP) -> Column:
    """Scored hits at or above ``minimum``, before false-positive removal.

    ``custom`` adds ``(name, pattern, confidence)`` rows; their kind is ``custom``.
    """
    find = lambda pattern: located(text, pattern, config.PII_CONTEXT)
    found = [gated(text, PII_GATES, config.PII_PATTERNS,
                   lambda kind, pattern: _scored(find(pattern), kind, partial(pii_confidence, kind)))]
    found += [_scored(find(pattern), "custom", partial(_fixed, confidence)) for _, pattern, confidence in custom or []]
    return F.filter(F.concat(*found), lambda h: h["confidence"] >= minimum)


def drop_false_positives(hits: Column) -> Column:
    return F.filter(hits, lambda h: ~pii_false_positive(h["kind"], h["value"], h["low"]))


def detect_pii(text: Column, custom: list[tuple[str, str, float]] | None = None) -> Column:
    """Personal data hits of a text."""
    return drop_false_positives(pii_candidates(text, custom))


def overall_confidence(hits: Column) -> Column:
    """Type-weighted mean confidence of a text's hits, 1.0 when there are none."""
    weights = F.create_map(*[F.lit(x) for pair in config.PII_WEIGHTS.items() for x in pair])
    weight = lambda h: F.coalesce(weights[h["kind"]], F.lit(0.5))
    top = F.aggregate(hits, F.lit(0.0), lambda acc, h: acc + h["confidence"] * weight(h))
    bottom = F.aggregate(hits, F.lit(0.0), lambda acc, h: acc + weight(h))
    return F.when(F.size(hits) == 0, 1.0).otherwise(top / bottom)


# --- indicators ---------------------------------------------------------------

def ip_scope(ip: Column) -> Column:
    """Kind of an address: system, private, reserved, public, ipv6_system, ipv6_reserved, ipv6, or invalid.

    System is loopback and link local. Only IPv4 has ``private``, the networks
    whose addresses become tokens; reserved ranges score as private and stay readable.
    """
    reserved = ip.rlike(config.RESERVED_IPV4) & ~ip.isin(config.RESERVED_IPV4_EXCEPT)
    v4 = (F.when(~ip.rlike(STRICT_IPV4), "invalid")
          .when(ip.rlike(r"^(?:127|169\.254)\."), "system")
          .when(ip.rlike(r"^(?:10|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\."), "private")
          .when(reserved, "reserved").otherwise("public"))
    v6 = let(ipv6_digits(ip), lambda d: F.when(d.isNull(), "invalid").when(d.rlike(config.SYSTEM_IPV6), "ipv6_system").when(
        d.rlike(config.RESERVED_IPV6) & ~d.rlike(config.RESERVED_IPV6_EXCEPT), "ipv6_reserved").otherwise("ipv6"))
    return F.when(ip.contains(":"), v6).otherwise(v4)


def ip_version(ip: Column) -> Column:
    """4 or 6, 0 when ``ip`` is no address."""
    return F.when(ip.contains(":"), F.when(ipv6_digits(ip).isNotNull(), 6).otherwise(0)).otherwise(F.when(ip.rlike(STRICT_IPV4), 4).otherwise(0))


def tokenised_ip(ip: Column) -> Column:
    """True for IPv4 addresses of the private, loopback and link-local networks."""
    return ip.rlike(STRICT_IPV4) & ip.rlike(r"^(?:10|127|192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01]))\.")


def indicator_confidence(kind: str, value: Column, low: Column) -> Column:
    def in_context(base: Column) -> Column:
        raised = F.when(contains_any(low, config.INDICATOR_ALERT_WORDS), F.least(base * 1.1, F.lit(1.0))).otherwise(base)
        return F.when(contains_any(low, config.INDICATOR_EXAMPLE_WORDS), raised * 0.7).otherwise(raised)

    if kind == "ip_address":
        # An address that does not parse starts at 0.3 and counts half.
        base = lambda scope: F.when(scope == "invalid", 0.3).when(scope.isin("system", "ipv6_system"), 0.9).when(
            scope.isin("private", "reserved", "ipv6_reserved"), 0.85).otherwise(0.8)
        return let(ip_scope(value), lambda scope: in_context(base(scope)) * F.when(scope == "invalid", 0.5).otherwise(1.0))
    return in_context(F.lit(0.95 if kind in ("file_hash", "cve") else 0.8))


def indicator_candidates(text: Column) -> Column:
    """Scored indicator hits outside personal-data contexts."""
    def clear(pattern: str) -> Column:
        hits = located(text, pattern, config.INDICATOR_CONTEXT, config.INDICATOR_PII_CONTEXT)
        return F.filter(hits, lambda h: ~contains_any(h["wide"], config.INDICATOR_PII_WORDS))

    return gated(text, INDICATOR_GATES, config.INDICATOR_PATTERNS,
                 lambda kind, pattern: _scored(clear(pattern), kind, partial(indicator_confidence, kind)))


def policy_minimum(kind: Column, policy: dict[str, tuple[str, float]] | None = None) -> Column:
    result = F.lit(config.INDICATOR_MINIMUM)
    for name, (_, minimum) in (policy or config.INDICATOR_POLICY).items():
        result = F.when(kind == name, minimum).otherwise(result)
    return result


def keep_original(kind: Column, value: Column, policy: dict[str, tuple[str, float]] | None = None, listed: Column | None = None) -> Column:
    """Whether an indicator stays readable: by type, address scope, known domain, threat list, policy."""
    low = F.lower(value)
    known = F.lit(False)
    for domain in config.KNOWN_DOMAINS:
        known = known | low.endswith(domain)
    keep = (kind.isin(config.INDICATOR_KEPT)
            | ((kind == "ip_address") & ~tokenised_ip(value))
            | ((kind == "domain") & known))
    if listed is not None:
        keep = keep | listed
    for name, (mode, _) in (policy or config.INDICATOR_POLICY).items():
        if mode in ("always", "never"):
            keep = F.when(kind == name, F.lit(mode == "always")).otherwise(keep)
    return keep


def indicator_token(kind: Column, value: Column) -> Column:
    """``TYPE_`` and eight hex digits of the value's md5, upper case."""
    prefix = F.when((kind == "ip_address") & tokenised_ip(value), "PRIVATE_IP").otherwise(F.upper(kind))
    hashed = F.when(kind == "domain", F.lower(value)).otherwise(value)
    return F.concat(prefix, F.lit("_"), F.upper(F.substring(F.md5(hashed), 1, 8)))


def threat_key(kind: Column, value: Column) -> Column:
    """How a listed value of a text is named in its array of threats."""
    return F.concat(kind, F.lit(":"), F.lower(value))


def boosted(kind: Column, confidence: Column, listed: Column) -> Column:
    """The confidence of a hit, raised by its type where a threat table lists it."""
    factor = F.lit(1.0)
    for name, boost in config.THREAT_BOOST.items():
        factor = F.when(kind == name, boost).otherwise(factor)
    return F.when(listed, F.least(F.lit(1.0), confidence * factor)).otherwise(confidence)


def with_threats(hits: Column, threats: Column) -> Column:
    """Hits with ``listed`` and the confidence raised; ``threats`` holds the ``threat_key`` of the text's listed values."""
    def judge(h):
        listed = F.coalesce(F.array_contains(threats, threat_key(h["kind"], h["value"])), F.lit(False))
        return F.struct(*[h[c].alias(c) for c in ("kind", "value", "start", "len", "context", "low")],
                        boosted(h["kind"], h["confidence"], listed).alias("confidence"), listed.alias("listed"))

    return F.transform(hits, judge)


def detect_indicators(text: Column, policy: dict[str, tuple[str, float]] | None = None, threats: Column | None = None) -> Column:
    """Indicator hits that reach the minimum confidence of their type, listed ones with the raised confidence."""
    hits = indicator_candidates(text)
    if threats is not None:
        hits = with_threats(hits, threats)
    return F.filter(hits, lambda h: h["confidence"] >= policy_minimum(h["kind"], policy))


def hash_type(value: Column) -> Column:
    result = F.lit("Unknown")
    for length, name in config.HASH_TYPES.items():
        result = F.when(F.length(value) == length, name).otherwise(result)
    return result
