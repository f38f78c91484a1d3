"""URL verdicts, components, tool calls and fingerprints, and every query against its SQL."""

import random

import parity
import pytest

from alertloom.llm import merkle, queries, tool_calls, url_filter
from alertloom.llm.components import components


@pytest.fixture(scope="module")
def con(sf):
    return parity.connect(sf)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, con, sf, name):
    assert parity.compare(spark, con, sf, name, queries.QUERIES[name], queries.ORACLES[name]) is None


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(300, 300 + i) for i in range(50)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = components(spark.createDataFrame([*edges, (None, 3), (5, 5)], "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted((v, find(v)) for v in root)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGES = [
    (1, "http://a.org/x", None), (2, "https://www.a.org/x.html?utm_source=q#top", ""), (3, "http://bad.net/es/1", '<link rel="canonical" href="http://a.org/x">'),
    (4, "http://c.org/y", '<META http-equiv="refresh" content="0; url=http://bad.net/fr/9">'), (5, "http://bad.net/fr/9", None),
    (6, "http://good.com/z", "<link href='http://c.org/y' rel='canonical'>"), (7, None, None), (8, "no scheme", None), (9, "http://", ""),
    (10, "HTTP://WWW.Example.COM/en/q", None), (11, "http://example.com/en", None), (12, "http://notexample.com/en/", None), (13, "http://x.example.com/en/a?b#c", None),
    (14, "http://lone.org/", "<link rel=canonical>"), (1, "http://a.org/x", None), (15, "http://com/x", None), (16, "http://d.org/p?id=1", None), (17, "http://d.org/p?id=2", None)]


def test_verdicts_follow_aliases(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, rule string")
    links = spark.createDataFrame([("http://d.org/p?id=1", "http://sub.net/es/"), ("http://d.org/p?id=2", None), (None, "x")], "a string, b string")
    seen = url_filter.url_verdicts(pages, queries.URL_RULES, spark.createDataFrame([("http://d.org/p?id=1", "http://bad.net/es/1")], "a string, b string"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in seen.collect()}
    assert seen.count() == len(PAGES)
    assert got[1] == ("a.org", "/x", None, "block") and got[2][3] == "block"  # aliases of a blocked page
    assert got[3] == ("bad.net", "/es/1", "net/es/", "block") and got[16][3] == "block" and got[17][3] == "allow"
    assert got[4] == ("c.org", "/y", None, "allow")  # a blocked and an allowed alias: the allow wins
    assert got[5][3] == "block" and got[6][2:] == ("com/", "allow")  # own rules stand
    assert got[7] == got[8] == got[9] == ("", "", None, "allow")
    assert got[10] == ("www.example.com", "/en/q", "www.example.com/en/", "allow")
    assert got[11][2:] == ("com/", "allow") and got[12][2:] == ("com/", "allow") and got[13] == ("x.example.com", "/en/a", "example.com/en/", "block")
    assert got[14][3] == "allow" and got[15][2:] == ("com/", "allow")
    assert url_filter.url_verdicts(pages.limit(0), queries.URL_RULES).count() == 0
    assert url_filter.url_verdicts(pages, queries.URL_RULES, links).count() == len(PAGES)


def test_rule_tables_equal_rule_expressions(spark, sf):
    pages = url_filter.with_parts(spark.read.parquet(f"{sf}/pages.parquet"))
    rules = spark.createDataFrame(queries.URL_RULES, "verdict string, rule string")
    plain = pages.withColumn("fit", url_filter.fitting_rule(queries.URL_RULES, pages["host"], pages["path"])).where("fit is not null")
    assert sorted(map(tuple, plain.selectExpr("host", "path", "fit.rule", "fit.verdict").distinct().collect())) == sorted(map(tuple, url_filter.match_table(pages, rules).collect()))


SCHEMAS = {"search": {"query": ("string", True), "limit": ("integer", False)}, "sum": {"a": ("number", True), "b": ("string", False)}}
CALLS = [
    (1, 1, "x", "search", '{"query":"a \\"q\\" é","limit":3}'), (1, 2, "y", "search", '{ "query" : "$z" }'), (1, 5, "z", "sum", '{"a":1.5}'), (1, 6, "w", "sum", '{"a":"s","c":1}'),
    (1, 7, "q", "sum", "nope"), (1, 8, "q", "sum", '{"a":1}'), (2, 1, "a", "sum", '{"a":1,"b":"$b"}'), (2, 2, "b", "sum", '{"a":1,"b":"$a"}'), (2, 3, "c", "sum", '{"a":1,"b":"$a"}'),
    (3, 1, None, "sum", '{"a":1}'), (3, 2, "k", "other", "{}"), (3, 3, "m", "sum", '{"b":"$nix","a":1}'), (4, 1, "g", "sum", '{"a":{"x":[1, 2]}}'), (4, 2, "h", None, None),
    (5, 1, "p", "sum", '{"a":1,"b":"$r"}'), (5, 2, "s", "sum", '{"a":1,"b":"$p"}'), (5, 3, "r", "sum", '{"a":1}'), (5, 4, "o", "sum", '{"a":1,"b":"$s"}'), (5, 4, "o", "sum", '{"a":1,"b":"$s"}')]
RESULTS = [(1, 3, "x", "r1"), (1, 4, "y", None), (1, 9, "nocall", "zz"), (2, 9, None, "n"), (1, 4, "x", "late"), (1, 3, "x", "r1")]


def test_tool_calls(spark):
    calls = spark.createDataFrame([(*c, "clash") for c in CALLS], "conv_id long, turn long, call_id string, name string, arguments string, content string")
    results = spark.createDataFrame(RESULTS, "conv_id long, turn long, call_id string, content string")
    linked = tool_calls.link(calls, results, SCHEMAS)
    got = {(r["conv_id"], r["call_id"], r["turn"]): r for r in linked.collect()}
    assert got[1, "x", 1]["line"] == '{"arguments":{"limit":3,"query":"a \\"q\\" é"},"id":"x","name":"search","result":"r1"}' and got[1, "x", 1]["problems"] == []
    assert (got[1, "y", 2]["position"], got[1, "y", 2]["hop"]) == (5, 1)  # after the call it refers to
    assert got[1, "w", 6]["problems"] == ["surplus:c", "type:a", "no result"]
    assert got[1, "q", 7]["problems"] == ["arguments", "no result"] and got[1, "q", 8]["problems"] == ["repeated", "no result"]
    assert all("cycle" in got[2, i, t]["problems"] and got[2, i, t]["position"] is None for i, t in (("a", 1), ("b", 2), ("c", 3)))
    assert got[3, "k", 2]["problems"] == ["tool", "no result"] and "reference:nix" in got[3, "m", 3]["problems"]
    assert got[4, "g", 1]["problems"] == ["type:a", "no result"] and got[4, "h", 2]["problems"] == ["arguments", "no result"]
    assert got[1, "nocall", 9]["problems"] == ["no call"] and got[2, None, 9]["problems"] == ["no call"]
    fifth = sorted((r["position"], r["hop"], r["turn"], i) for (c, i, _), r in got.items() if c == 5)
    assert [x[-1] for x in fifth] == ["r", "p", "s", "o"]
    assert linked.count() == len(CALLS) + 2
    assert tool_calls.link(calls.limit(0), results.limit(0), SCHEMAS).count() == 0


NESTED = {"t": {"o": ("object", False), "l": ("array", False), "n": ("array<integer>", False), "e": (["a", 1, None], False), "u": ("null", False),
                "p": ({"x": ("number", True), "y": ("array<array<string>>", False)}, False)}}
FITS = ['{"o":{},"l":[],"n":[],"e":"a"}', '{"o":{"k":[1]},"l":[1,"b"],"n":[1,-2],"e":1}', '{"e":null,"u":null,"p":{"x":1.5}}', '{"p":{"y":[["a"],[]],"x":2}}']
FAILS = [('{"o":[]}', "o"), ('{"l":{}}', "l"), ('{"n":[1,"2"]}', "n"), ('{"n":[null]}', "n"), ('{"n":1}', "n"), ('{"e":"b"}', "e"), ('{"u":0}', "u"), ('{"p":{}}', "p"),
         ('{"p":{"x":"1"}}', "p"), ('{"p":{"x":1,"z":1}}', "p"), ('{"p":{"x":1,"y":[[1]]}}', "p"), ('{"p":3}', "p"), ('{"o":"{}"}', "o"), ('{"l":"[1]"}', "l")]


def test_nested_schemas(spark):
    wanted = [(a, []) for a in FITS] + [(a, [f"type:{m}"]) for a, m in FAILS]
    calls = spark.createDataFrame([(1, i, str(i), "t", a) for i, (a, _) in enumerate(wanted)], "conv_id long, turn long, call_id string, name string, arguments string")
    results = spark.createDataFrame([(1, 99, str(i), "r") for i in range(len(wanted))], "conv_id long, turn long, call_id string, content string")
    got = {r["turn"]: r["problems"] for r in tool_calls.link(calls, results, NESTED).collect()}
    assert [got[i] for i in range(len(wanted))] == [p for _, p in wanted]


TEXTS = [(1, None), (2, ""), (3, "ab"), (4, "One. Two!\nThree.\n\nFour"), (5, "One. Two!\nThree.\n\nFour"), (7, "x" * 100_000), (9, "\n\n\n"), (11, "é日\U0001F600" * 40), (11, "other"), (None, "none")]


@pytest.mark.parametrize("range_rows", [1, 3, 1000])
def test_next_documents_and_fingerprints(table, range_rows):
    cases = [c for c in TEXTS if c[0] != 11 or c[1] != "other"]
    got = {r["doc_id"]: r for r in merkle.compare_with_edit(table(cases), range_rows=range_rows).collect()}
    order = [c for c in sorted(cases, key=lambda c: -1 if c[0] is None else c[0], reverse=True)]
    import hashlib
    for (i, text), (_, follows) in zip(order, order[1:] + order[:1], strict=True):
        text, follows = text or "", follows or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + follows[:cut]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), i
        assert (got[i]["fingerprint"] == got[i]["edited_fingerprint"]) == (text == edited)
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[4]["fingerprint"] == got[5]["fingerprint"] and got[5]["near_next"] == 1.0 and got[1]["fingerprint"] == got[2]["fingerprint"]
    assert len({r["fingerprint"] for r in got.values()}) == len({t or "" for _, t in cases})


def test_fingerprints_of_ties_and_nothing(table):
    assert merkle.compare_with_edit(table(TEXTS + TEXTS)).count() == 2 * len(TEXTS)
    assert merkle.compare_with_edit(table([])).count() == 0
    assert merkle.compare_with_edit(table([(None, "a")])).count() == 1


def test_differing_branches_locate_an_edit(table):
    from pyspark.sql import functions as F

    a, b = "p one.\np two.\n\nq one.\nq two.", "p one.\np two.\n\nq one.\nq 2."
    prints = merkle.fingerprints(table([(1, a), (2, b)]))
    x, y = (prints.where(f"doc_id = {i}").select(F.struct("sections", "paragraphs").alias(n)) for i, n in ((1, "a"), (2, "b")))
    both = x.join(y)
    row = both.select(merkle.differing(F.col("a.sections"), F.col("b.sections")).alias("s"), merkle.differing(F.col("a.paragraphs")[1], F.col("b.paragraphs")[1]).alias("p")).first()
    assert row["s"] == [1] and row["p"] == [1]
