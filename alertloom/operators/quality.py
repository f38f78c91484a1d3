"""Row validation, injection scans, sanitising and JSON repair."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom import config


@dataclass
class Rule:
    """One column rule; ``check`` is a caller's own boolean column function."""

    column: str
    kind: str = "string"
    required: bool = False
    min_length: int | None = None
    max_length: int | None = None
    min_value: float | None = None
    max_value: float | None = None
    allowed: list | None = None
    pattern: str | None = None
    check: Callable[[Column], Column] | None = None
    sanitize: bool = True
    message: str | None = None


def sanitize_html(text: Column) -> Column:
    """Escape ``& < > " '``, the ampersand first."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def json_depth(text: Column, cap: int = config.MAX_JSON_DEPTH) -> Column:
    """Nesting depth of JSON text: scalars 0, containers one more than their content.

    String literals are removed first; an empty container adds nothing, as its
    level counts only when it holds something. Depths beyond ``cap`` read ``cap + 1``.
    """
    bare = F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "0")
    bare = F.regexp_replace(bare, r"\{\s*\}|\[\s*\]", "0")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    walk = F.aggregate(
        marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")),
        lambda acc, c: F.struct(
            (acc["now"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)).alias("now"),
            F.greatest(acc["top"], acc["now"] + F.when(c.isin("{", "["), 1).otherwise(0)).alias("top")),
        lambda acc: acc["top"])
    return F.least(walk, F.lit(cap + 1))


def _errors(rule: Rule) -> list[Column]:
    """Messages of one rule; null where it holds."""
    col = F.col(rule.column)
    text = F.trim(col.cast("string"))
    bad = lambda failed, message: F.when(col.isNotNull() & F.coalesce(failed, F.lit(True)), F.lit(f"{rule.column}: {message}"))
    out = [F.when(col.isNull(), F.lit(f"{rule.column}: required"))] if rule.required else []
    if rule.kind in ("integer", "float"):
        number = text.try_cast("bigint" if rule.kind == "integer" else "double")
        out.append(bad(number.isNull(), f"not a valid {'integer' if rule.kind == 'integer' else 'number'}"))
        if rule.min_value is not None:
            out.append(F.when(number < rule.min_value, F.lit(f"{rule.column}: too small")))
        if rule.max_value is not None:
            out.append(F.when(number > rule.max_value, F.lit(f"{rule.column}: too large")))
        if rule.allowed:
            out.append(F.when(number.isNotNull() & ~number.isin(rule.allowed), F.lit(f"{rule.column}: not allowed")))
    elif rule.kind == "string":
        size = F.length(col.cast("string"))
        if rule.min_length is not None:
            out.append(bad(size < rule.min_length, "too short"))
        if rule.max_length is not None:
            out.append(bad(size > rule.max_length, "too long"))
        out.append(bad(size > config.MAX_STRING_LENGTH, "exceeds system limit"))
        if rule.allowed:
            out.append(bad(~col.isin(rule.allowed), "not allowed"))
    elif rule.kind == "boolean":
        out.append(bad(~F.lower(text).isin("true", "1", "yes", "on", "false", "0", "no", "off"), "not a valid boolean"))
    elif rule.kind == "email":
        out.append(bad(~F.lower(text).rlike(config.VALID_EMAIL), "invalid email format"))
    elif rule.kind == "url":
        out.append(bad(~text.rlike(config.VALID_URL), "invalid URL format"))
    elif rule.kind == "ip_address":
        out.append(bad(~(text.rlike(config.VALID_IPV4) | text.rlike(config.VALID_IPV6)), "invalid IP address format"))
    elif rule.kind == "uuid":
        out.append(bad(~text.rlike(config.VALID_UUID), "invalid UUID format"))
    elif rule.kind == "json":
        parsed = F.try_parse_json(col)
        out.append(bad(parsed.isNull(), "invalid JSON"))
        out.append(F.when(parsed.isNotNull() & (json_depth(col) > config.MAX_JSON_DEPTH), F.lit(f"{rule.column}: JSON too deeply nested")))
    elif rule.kind == "sql_safe":
        out.append(bad(col.rlike(config.SQL_INJECTION), "potential SQL injection"))
    elif rule.kind == "filename":
        crossing = text.rlike(config.PATH_TRAVERSAL)
        out.append(bad(crossing, "path traversal in filename"))
        out.append(bad(~crossing & ~text.rlike(config.VALID_FILENAME), "invalid filename format"))
    elif rule.kind == "regex":
        # the pattern must match from the first character on
        out.append(bad(~col.rlike(f"^(?:{rule.pattern})"), rule.message or "does not match required pattern"))
    elif rule.kind == "custom":
        out.append(bad(~rule.check(col), rule.message or "custom validation failed"))
    else:
        raise ValueError(f"unknown rule kind {rule.kind}")
    return out


def _clean(rule: Rule) -> Column:
    col = F.col(rule.column)
    text = F.trim(col.cast("string"))
    if rule.kind == "string":
        return sanitize_html(col.cast("string")) if rule.sanitize else col.cast("string")
    if rule.kind == "boolean":
        low = F.lower(text)
        return F.when(low.isin("true", "1", "yes", "on"), True).when(low.isin("false", "0", "no", "off"), False)
    if rule.kind in ("email", "uuid"):
        return F.lower(text)
    if rule.kind == "integer":
        return text.try_cast("bigint")
    if rule.kind == "float":
        return text.try_cast("double")
    return text if rule.kind in ("url", "ip_address", "filename") else col


def validate(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows with ``errors`` and ``warnings`` arrays and cleaned columns ``<name>_clean``.

    One projection, whatever the number of rules.
    """
    errors = F.array_compact(F.array(*[e for rule in rules for e in _errors(rule)]))
    escaped = [F.when(sanitize_html(F.col(r.column).cast("string")) != F.col(r.column).cast("string"), F.lit(f"{r.column}: HTML-escaped"))
               for r in rules if r.kind == "string" and r.sanitize]
    warnings = F.array_compact(F.array(*escaped)) if escaped else F.array().cast("array<string>")
    # several rules may share a column; the first one says how it is cleaned
    first = {r.column: r for r in reversed(rules)}
    return rows.select("*", errors.alias("errors"), warnings.alias("warnings"),
                       *[_clean(r).alias(f"{c}_clean") for c, r in first.items()])


def scan_injection(row_json: Column, text: Column) -> list[Column]:
    """Flags over the whole row as JSON, and SQL injection over one column."""
    return [row_json.rlike(config.XSS).alias("xss"), row_json.rlike(config.COMMAND_INJECTION).alias("command_injection"),
            row_json.rlike(config.PATH_TRAVERSAL).alias("path_traversal"), text.rlike(config.SQL_INJECTION).alias("sql_injection")]


def record_checks(level: Column, text: Column, quality: Column, month: Column, quarter: Column) -> Column:
    """Names of the rules a summary record breaks."""
    failed = [
        F.when(~quality.between(0, 1), "quality"), F.when(~month.between(1, 12), "month"), F.when(~quarter.between(1, 4), "quarter"),
        F.when(~level.isin(list(config.SUMMARY_LENGTHS)), "level")]
    for name, (low, high) in config.SUMMARY_LENGTHS.items():
        failed.append(F.when((level == name) & ~F.length(text).between(low, high), "text_length"))
    return F.array_compact(F.array(*failed))


# --- JSON repair -------------------------------------------------------------------

def _balanced(text: Column) -> Column:
    """From the first opening bracket to its partner, or to the last closing one."""
    braced = text.contains("{")
    opening, closing = F.when(braced, "{").otherwise("["), F.when(braced, "}").otherwise("]")
    start = F.instr(text, "{")
    start = F.when(braced, start).otherwise(F.instr(text, "["))
    rest = F.substring(text, start, F.length(text))
    # pieces after each closing bracket; the depth after a piece tells where it ends
    walk = F.aggregate(
        F.split(rest, ""), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end")),
        lambda acc, c: F.when(acc["end"] > 0, acc).otherwise(F.struct(
            (acc["depth"] + F.when(c == opening, 1).when(c == closing, -1).otherwise(0)).alias("depth"),
            (acc["at"] + F.length(c)).alias("at"),
            F.when((c == closing) & (acc["depth"] == 1), acc["at"] + 1).otherwise(0).alias("end"))),
        lambda acc: acc["end"])
    last = F.length(rest) - F.length(F.substring_index(rest, "}", -1))
    return F.when(start == 0, F.lit(None).cast("string")).otherwise(
        F.substring(rest, F.lit(1), F.when(walk > 0, walk).otherwise(last)))


def repair_json(text: Column) -> Column:
    """First parseable JSON found in messy text, or null.

    Candidates in order: fenced block, raw text, outermost braces; each cut to
    balanced brackets and tried as is, without trailing commas, with double
    quotes, without newlines, with quoted keys, and with all of these.
    """
    trimmed = F.trim(text)
    fenced = F.regexp_extract(trimmed, r"(?s)```(?:json)?(.*)```", 1)
    outer = F.regexp_extract(trimmed, r"(?s)(\{.*\})", 1)
    places = F.filter(F.array(F.trim(fenced), trimmed, outer), lambda c: c != "")
    cut = F.array_distinct(F.filter(F.transform(places, _balanced), lambda c: c.isNotNull() & (c != "")))

    def fixes(c: Column) -> Column:
        commas = lambda s: F.regexp_replace(s, r",(\s*[}\]])", "$1")
        quotes = lambda s: F.translate(s, "'", '"')
        keys = lambda s: F.regexp_replace(s, r"(\w+):", '"$1":')
        lines = lambda s: F.replace(F.replace(s, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))
        return F.array(c, commas(c), quotes(c), lines(c), keys(c), commas(keys(quotes(c))))

    tried = F.array_distinct(F.flatten(F.transform(cut, fixes)))
    return F.get(F.filter(tried, lambda c: F.try_parse_json(c).isNotNull()), F.lit(0))
