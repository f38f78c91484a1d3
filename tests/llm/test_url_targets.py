"""Redirect and canonical targets that are no page."""

from alertloom.llm import queries, url_filter


def test_targets_outside_the_table_are_judged(spark):
    refresh = '<meta http-equiv="refresh" content="0;url={}">'
    canonical = '<link rel="canonical" href="{}">'
    rows = [(1, "http://a.org/x", refresh.format("http://bad.net/es/9")), (2, "http://b.org/x", canonical.format("//bad.net/fr/1")),
            (3, "http://c.org/x", None), (4, "http://d.org/x", refresh.format("https://bad.net/es/8") + canonical.format("http://good.com/")),
            (5, "http://bad2.net/xx/y", refresh.format("../es/1")), (6, "http://bad3.net", refresh.format("es/q?u=http://good.com/")),
            (7, "http://e.org/x", canonical.format("mailto:me@good.com"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    links = spark.createDataFrame([("http://c.org/x", "http://bad.net/es/7")], "a string, b string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.url_verdicts(pages, queries.URL_RULES, links).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "block", 7: "allow"}


def test_relative_targets(spark):
    canonical = '<link rel="canonical" href="{}">'
    hrefs = {"p": "h.org/a/p", "./p": "h.org/a/p", "../p": "h.org/p", "../../../p/.": "h.org/p/", "?q=1": "h.org/a/b?q=1", "//o.org/z": "o.org/z", "/z?u=http://o.org/y": "h.org/z?u=http://o.org/y"}
    for href, want in hrefs.items():
        page = spark.createDataFrame([("http://h.org/a/b", canonical.format(href))], "url string, html string")
        assert [r["b"] for r in url_filter.declared_links(page).collect()] == [want], href
    for href in ("#top", "javascript:void(0)"):
        page = spark.createDataFrame([("http://h.org/a/b", canonical.format(href))], "url string, html string")
        assert url_filter.declared_links(page).count() == 0
