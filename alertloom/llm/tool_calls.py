"""Tool calls of conversations: linked, ordered, validated, serialised.

Calls and results are joined by conversation and call identifier. The calls of a
conversation are put in an order in which every call comes after the calls it
refers to (``"$id"`` values of its arguments), otherwise in order of their turns.
Arguments are validated against the schema of their tool, and each call becomes
one line of canonical JSON: keys sorted, no blanks, arguments in schema order of
their names.

Order: the position of a call is the largest of its own turn and the positions
of the calls it refers to; a call that only moved because of another comes behind
it (``hop``). Calls that refer to earlier turns keep their own, so only chains of
forward references take rounds: one per link, over the moving calls alone. Calls
on a cycle, or behind one, have no order: they come last and are marked.

All of it is DataFrame expressions. Arguments that are no JSON object, unknown
tools, missing or surplus or wrongly typed arguments, references to unknown
calls, missing results and results without call are reported in ``problems``.
Null identifiers match nothing. Of several calls of one identifier the first
turn counts, the others are reported as ``repeated``; so with results. Empty
tables give empty results.
"""

from __future__ import annotations

import functools
import json
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.session import cut_lineage

#: name -> {argument: (type, required)}; types: string, integer, number, boolean, object, array, null, ``array<type>``, a list
#: of the allowed JSON values (an enum), or {member: (type, required)} for an object with these members and no others
Schemas = dict[str, dict[str, tuple[str | list | dict, bool]]]
_ARGS = "map<string,string>"
_NUMBER = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"


def _typed(raw: Column, kind: str | list | dict) -> Column:
    """Whether a JSON value, as ``variant`` text, has the type. Numbers of equal value have one text, so 1.0 is an integer."""
    if isinstance(kind, list):
        allowed = [F.to_json(F.parse_json(F.lit(json.dumps(v)))) for v in kind]
        return raw.isin(*allowed) if allowed else F.lit(False)
    if isinstance(kind, dict):
        members = _raw_arguments(raw)
        fits = [F.when(F.map_contains_key(members, F.lit(m)), _typed(F.try_element_at(members, F.lit(m)), of)).otherwise(F.lit(not required))
                for m, (of, required) in sorted(kind.items())]
        known = F.forall(F.map_keys(members), lambda k: k.isin(*kind) if kind else F.lit(False))
        return F.when(members.isNull(), F.lit(False)).otherwise(functools.reduce(operator.and_, fits, known))
    if kind.startswith("array<") and kind.endswith(">"):
        items = F.transform(F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>"), lambda v: F.to_json(v))
        return F.when(raw.startswith("["), F.coalesce(F.forall(items, lambda v: _typed(F.coalesce(v, F.lit("null")), kind[6:-1])), F.lit(False))).otherwise(F.lit(False))
    if kind in ("object", "array"):
        return raw.startswith("{" if kind == "object" else "[")
    if kind == "string":
        return raw.startswith('"')
    if kind in ("boolean", "null"):
        return raw.isin("true", "false") if kind == "boolean" else raw == "null"
    if kind == "integer":
        return raw.rlike(r"^-?(?:0|[1-9][0-9]*)$")
    if kind == "number":
        return raw.rlike(_NUMBER)
    raise ValueError(f"unknown type {kind}")


def _raw_arguments(text: Column) -> Column:
    """map name -> JSON text of the value; null where the arguments are no object."""
    parsed = F.try_parse_json(text)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    named = F.when(is_object, F.try_variant_get(parsed, "$", "map<string,variant>"))
    return F.transform_values(named, lambda _, v: F.to_json(v))


def _problems(name: Column, args: Column, schemas: Schemas) -> Column:
    """Array of what is wrong with the arguments of a call, sorted."""
    found = F.when(args.isNull(), F.array(F.lit("arguments")))
    for tool, wanted in sorted(schemas.items()):
        checks = [F.when(~F.map_contains_key(args, F.lit(a)), F.lit(f"missing:{a}") if required else F.lit(None).cast("string"))
                  .when(~_typed(args[a], kind), F.lit(f"type:{a}")) for a, (kind, required) in sorted(wanted.items())]
        surplus = F.transform(F.filter(F.map_keys(args), lambda k: ~k.isin(*wanted) if wanted else F.lit(True)), lambda k: F.concat(F.lit("surplus:"), k))
        listed = F.array(*checks) if checks else F.array().cast("array<string>")
        found = found.when(name == tool, F.array_sort(F.array_compact(F.concat(listed, surplus))))
    return found.otherwise(F.array(F.lit("tool")))


def _json_text(text: Column) -> Column:
    return F.to_json(F.to_variant_object(F.struct(text.alias("v")))).substr(F.lit(6), F.length(F.to_json(F.to_variant_object(F.struct(text.alias("v"))))) - 6)


def canonical(call_id: Column, name: Column, args: Column, result: Column) -> Column:
    """``{"arguments":{...},"id":...,"name":...,"result":...}`` with sorted keys and no blanks."""
    pairs = F.transform(F.array_sort(F.map_keys(args)), lambda k: F.concat(_json_text(k), F.lit(":"), F.element_at(args, k)))
    return F.concat(F.lit('{"arguments":{'), F.coalesce(F.array_join(pairs, ","), F.lit("")), F.lit('},"id":'), F.coalesce(_json_text(call_id), F.lit("null")),
                    F.lit(',"name":'), F.coalesce(_json_text(name), F.lit("null")), F.lit(',"result":'), F.coalesce(_json_text(result), F.lit("null")), F.lit("}"))


def _first(df: DataFrame, *order: str) -> DataFrame:
    """Marks rows after the first of their (conv_id, call_id); equal rows are ordered arbitrarily, as they are equal."""
    ranked = df.groupBy("conv_id", "call_id").agg(F.min(F.struct(*order)).alias("_least"))
    return df.join(ranked, ["conv_id", "call_id"], "left").withColumn("repeated", ~F.struct(*order).eqNullSafe(F.col("_least")) & F.col("call_id").isNotNull()).drop("_least")


def _ordered(calls: DataFrame, links: DataFrame) -> DataFrame:
    """``conv_id, call_id, position, hop`` of the calls that references move or that lie on cycles (``hop`` null).

    calls: ``conv_id, call_id, turn``; links: ``conv_id, call_id, needs``, both ends known.
    """
    turn = calls.select("conv_id", F.col("call_id").alias("needs"), F.col("turn").alias("at"))
    edges = cut_lineage(links.join(turn, ["conv_id", "needs"]).join(calls, ["conv_id", "call_id"]), "needs")
    # calls that a forward reference moves, and those that refer to such a call
    moving = cut_lineage(edges.where("at >= turn").select("conv_id", "call_id").distinct(), "moving")
    n = moving.count()
    while n:
        more = edges.join(moving.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "left_semi").select("conv_id", "call_id")
        moving = cut_lineage(moving.unionByName(more).distinct(), "moving")
        n, before = moving.count(), n
        if n == before:
            break
    inside = cut_lineage(edges.join(moving, ["conv_id", "call_id"], "left_semi"), "inside")
    open_calls = cut_lineage(calls.join(moving, ["conv_id", "call_id"], "left_semi"), "open")
    done = open_calls.select("conv_id", "call_id", F.col("turn").alias("position"), F.lit(0).alias("hop")).limit(0)
    while not open_calls.isEmpty():
        waiting = inside.join(open_calls.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_semi").select("conv_id", "call_id").distinct()
        ready = open_calls.join(waiting, ["conv_id", "call_id"], "left_anti")
        known = (inside.join(done.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "left")
                 .select("conv_id", "call_id", F.struct(F.coalesce("position", "at").alias("position"), (F.coalesce("hop", F.lit(0)) + 1).alias("hop")).alias("p")))
        placed = (ready.join(known, ["conv_id", "call_id"], "left").groupBy("conv_id", "call_id", "turn").agg(F.max("p").alias("p"))
                  .withColumn("p", F.greatest("p", F.struct(F.col("turn").alias("position"), F.lit(0).alias("hop"))))
                  .select("conv_id", "call_id", "p.position", "p.hop"))
        placed = cut_lineage(placed, "placed")
        if placed.isEmpty():
            break
        done = cut_lineage(done.unionByName(placed), "done")
        open_calls = cut_lineage(open_calls.join(placed, ["conv_id", "call_id"], "left_anti"), "open")
    return done.unionByName(open_calls.select("conv_id", "call_id", F.col("turn").alias("position"), F.lit(None).cast("int").alias("hop")))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call and per result without call.

    calls: ``conv_id, turn, call_id, name, arguments`` (JSON text); results:
    ``conv_id, turn, call_id, content``. Gives ``conv_id, call_id, turn, name,
    position, hop, problems, line``; sort by ``conv_id, position, hop, turn``.
    ``position`` and ``hop`` are null for results without call and for cycles.
    """
    raw = calls.select("conv_id", "turn", "call_id", "name", "arguments")
    marked = cut_lineage(_first(raw, "turn", "name", "arguments").withColumn("args", _raw_arguments(F.col("arguments"))), "calls")
    answers = _first(results.select("conv_id", "turn", "call_id", "content"), "turn", "content").where("not repeated").dropDuplicates(["conv_id", "call_id"])
    known = marked.where("not repeated and call_id is not null").select("conv_id", "call_id", "turn").distinct()
    needs = marked.where("not repeated").select("conv_id", "call_id", F.explode(F.map_values("args")).alias("v")).where(F.col("v").startswith('"$')).select(
        "conv_id", "call_id", F.expr("substring(v, 3, length(v) - 3)").alias("needs")).distinct()
    there = known.select("conv_id", F.col("call_id").alias("needs"))
    lost = needs.join(there, ["conv_id", "needs"], "left_anti").groupBy("conv_id", "call_id").agg(F.sort_array(F.collect_set(F.concat(F.lit("reference:"), "needs"))).alias("lost"))
    moved = _ordered(known, needs.join(there, ["conv_id", "needs"], "left_semi"))
    joined = (marked.join(answers.select("conv_id", "call_id", "content", F.lit(True).alias("answered")), ["conv_id", "call_id"], "left")
              .join(moved.withColumn("was_moved", F.lit(True)), ["conv_id", "call_id"], "left").join(lost, ["conv_id", "call_id"], "left"))
    cyclic = F.coalesce("was_moved", F.lit(False)) & F.col("hop").isNull()
    none = F.array().cast("array<string>")
    out = joined.select(
        "conv_id", "call_id", "turn", "name",
        F.when(~cyclic, F.coalesce("position", "turn")).alias("position"), F.when(~cyclic, F.coalesce("hop", F.lit(0))).alias("hop"),
        F.concat(_problems(F.col("name"), F.col("args"), schemas), F.coalesce("lost", none),
                 F.when(cyclic, F.array(F.lit("cycle"))).otherwise(none), F.when(F.col("repeated"), F.array(F.lit("repeated"))).otherwise(none),
                 F.when(F.col("answered").isNull(), F.array(F.lit("no result"))).otherwise(none)).alias("problems"),
        canonical(F.col("call_id"), F.col("name"), F.col("args"), F.col("content")).alias("line"))
    orphans = results.select("conv_id", "call_id", "turn", "content").join(known.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
    empty = F.lit(None).cast(_ARGS)
    nothing = F.lit(None).cast("string")
    return out.unionByName(orphans.select(
        "conv_id", "call_id", "turn", nothing.alias("name"), F.lit(None).cast(out.schema["position"].dataType).alias("position"), F.lit(None).cast("int").alias("hop"),
        F.array(F.lit("no call")).alias("problems"), canonical(F.col("call_id"), nothing, empty, F.col("content")).alias("line")))
