"""URL rules, and block decisions that follow redirects and canonical links.

A rule names a host (with its subdomains) and the start of a path; the longest
rule that fits decides. Urls that no rule fits take the decision of their
aliases: pages linked by redirects, by declared canonical urls or by equal
canonical form are one component, found with distributed connected components.
Every url of a component is judged by the rules, whether it is a page or only the
target of a link.
In a component an explicit allow beats a block; without either, and for a url
without aliases, the verdict is allow. A url's own rule always stands.

All of it is DataFrame expressions. Null urls and urls without ``://`` have an
empty host and path, no rule, no alias, and are allowed. Repeated rows get equal
results; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.components import components
from alertloom.session import cut_lineage

# fixed values
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: host labels that redirect to the bare host
ALIAS_LABELS = "www|m"
#: query parameters that do not change the page
TRACKING = "utm_[a-z]+|ref|gclid|fbclid"
MAX_RULES = 1000


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("`url`"))).otherwise(F.lit(""))


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds ``host, path, rest`` to a table with a column ``url``."""
    rest = F.coalesce(_rest(F.col("url")), F.lit(""))
    return (pages.withColumn("rest", rest)
            .withColumn("host", F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), UPPER, LOWER))
            .withColumn("path", F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1)))


def fitting_rule(rules: list[tuple[str, str]], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest (verdict, host/path) rule that fits, allow first among equals, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules as an expression; join a rule table with match_table")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda x: (len(x[1]), x[0] == "allow")):
        name, _, tail = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def match_table(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for a large table of rules (``verdict, rule``): distinct (``host, path``) with ``rule, verdict``.

    Urls meet only the rules of their own host and its parents.
    """
    parted = rules.select(
        "verdict", "rule", F.substring_index("rule", "/", 1).alias("rule_host"),
        F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("rule_path"))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = (urls.select("host", "path").distinct().withColumn("rule_host", F.explode(parents)).join(parted, "rule_host")
             .where(F.col("path").startswith(F.col("rule_path"))))
    best = F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "allow").alias("first"), "rule", "verdict")).alias("best")
    return found.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.verdict")


def node(rest: Column) -> Column:
    """A url without scheme, fragment and tracking parameters, host in lower case."""
    bare = F.regexp_replace(rest, "#.*$", "")
    kept = F.array_join(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: ~p.rlike(f"^(?:{TRACKING})=") & (p != "")), "&")
    place = F.regexp_extract(bare, r"^([^/?]*)([^?]*)", 1)
    path = F.regexp_extract(bare, r"^([^/?]*)([^?]*)", 2)
    return F.concat(F.translate(place, UPPER, LOWER), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def canonical_form(name: Column) -> Column:
    """The node to which a site itself would redirect: bare host, no page suffix."""
    return F.regexp_replace(F.regexp_replace(name, rf"^(?:{ALIAS_LABELS})\.", ""), r"(?:/index)?\.html?(?=$|\?)", "")


def _without_dots(rest: Column) -> Column:
    """Host and path with the steps ``.`` and ``..`` of the path taken."""
    place, tail = F.regexp_extract(rest, r"^[^?#]*", 0), F.regexp_extract(rest, r"^[^?#]*(.*)$", 1)
    step = F.split(place, "/")
    walked = F.aggregate(F.slice(step, 2, F.size(step)), F.slice(step, 1, 1), lambda done, s: F.when(s == ".", done).when(
        s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(s))))
    last = F.element_at(step, -1)
    path = F.concat(F.array_join(walked, "/"), F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit("")))
    return F.when(place.rlike(r"/\.\.?(?:/|$)"), F.concat(path, tail)).otherwise(rest)


def declared_links(pages: DataFrame) -> DataFrame:
    """``a, b``: each page (``url, html``) with its canonical link and its refresh redirect, and its canonical form."""
    head = F.coalesce(F.col("html"), F.lit(""))
    tag = F.regexp_extract(head, r"""(?i)<link[^>]*rel=["']?canonical["'][^>]*>""", 0)
    canonical = F.regexp_extract(tag, r"""(?i)href=["']([^"']+)["']""", 1)
    refresh = F.regexp_extract(head, r"""(?i)<meta[^>]*http-equiv=["']?refresh["']?[^>]*url=['"]?([^"'>\s]+)""", 1)
    base = with_parts(pages.select("url", canonical.alias("canonical"), refresh.alias("refresh"))).where(F.col("host") != "").withColumn("a", node(F.col("rest")))

    def target(href: Column) -> Column:
        href = F.trim(href)
        folder = F.regexp_replace(F.when(F.col("path") == "", F.lit("/")).otherwise(F.col("path")), "[^/]*$", "")
        far = (F.when(href == "", F.lit(None).cast("string"))
               .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.regexp_replace(href, "^[^:]*://", ""))
               .when(href.startswith("//"), F.regexp_replace(href, "^//", ""))
               .when(href.startswith("/"), F.concat("host", href))
               .when(href.startswith("?"), F.concat(F.col("host"), F.col("path"), href))
               .when(href.rlike("^#|^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))  # the page itself; no url of a host
               .otherwise(F.concat(F.col("host"), folder, href)))
        return node(_without_dots(far))

    links = F.array_compact(F.array(target(F.col("canonical")), target(F.col("refresh")), canonical_form(F.col("a"))))
    return base.select("a", F.explode(links).alias("b")).where(F.col("a") != F.col("b"))


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]], links: DataFrame | None = None, page_id: str = "page_id",
                 url: str = "url", html: str | None = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict, component`` of every page.

    ``links`` are further redirects (``a, b``, both urls). ``component`` is the
    smallest node of a url's aliases, null for a url without any.
    """
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    text = pages.select(F.col(url).alias("url"), (F.col(html) if html else F.lit(None).cast("string")).alias("html"))
    edges = declared_links(text)
    if links is not None:
        ends = links.select(F.col("a").alias("from"), F.col("b").alias("to")).where("instr(`from`, '://') > 0 and instr(`to`, '://') > 0")
        edges = edges.unionByName(ends.select(*(node(F.expr(f"substring(`{c}`, instr(`{c}`, '://') + 3)")).alias(n) for c, n in (("from", "a"), ("to", "b")))))
    roots = components(edges)
    parted = with_parts(own).withColumn("fit", fitting_rule(rules, F.col("host"), F.col("path"))).select(
        "page_id", "host", "path", F.when(F.col("host") != "", node(F.col("rest"))).alias("node"), "fit.rule", "fit.verdict")
    # rows that can meet nothing stay out of the joins: null keys would all be one task's
    placed = parted.where("node is not null").join(roots.withColumnRenamed("root", "component"), "node", "left")
    alone = parted.where("node is null").withColumn("component", F.lit(None).cast("string"))
    judged = cut_lineage(placed.unionByName(alone), "urls")
    place = F.regexp_extract("node", "^[^/?]*", 0), F.regexp_extract("node", r"^[^/?]*([^?]*)", 1)
    seen = roots.select(F.col("root").alias("component"), fitting_rule(rules, *place)["verdict"].alias("verdict")).unionByName(judged.select("component", "verdict"))
    # written, so that the join below has sides of its own: a large component's pages can be split there
    classes = cut_lineage(seen.where("component is not null and verdict is not null").groupBy("component")
                          .agg(F.max(F.col("verdict") == "allow").alias("allowed")), "classes")
    open_ = F.col("component").isNotNull() & F.col("verdict").isNull()
    inherited = judged.where(open_).join(classes, "component", "left").withColumn(
        "verdict", F.when(~F.col("allowed"), F.lit("block")).otherwise(F.lit("allow")))
    own_rule = judged.where(~open_).withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    columns = ["page_id", "host", "path", "rule", "verdict", "component"]
    return inherited.select(columns).unionByName(own_rule.select(columns))
