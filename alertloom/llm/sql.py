"""DuckDB forms of the queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, list_slice(w, i, i + least(13, len(w)) - 1) AS gram
      FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT size FROM g),
v AS (SELECT k, size, i, list_slice(w, i, i + size - 1) AS gram
      FROM (SELECT k, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, s WHERE len(w) >= size)),
h AS (SELECT v.k, v.i, v.size, g.item_id FROM v JOIN g ON v.size = g.size AND v.gram = g.gram),
c AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(generate_series(i, i + size - 1)) AS p FROM h) GROUP BY k),
t AS (SELECT k, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM h GROUP BY k)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(t.items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(t.items, ','), '')) AS items_sha256,
       coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c ON d.k = c.k LEFT JOIN t ON d.k = t.k
"""


def _tree(text: str) -> str:
    return f"""list_transform(string_split({text}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p:
        list_transform(regexp_extract_all(p, '[^.!?]{{1,32}}[.!?]*|[.!?]+'), lambda x: left(sha256(x), 16))))"""


def _near(a: str, b: str) -> str:
    both = f"(len(list_distinct(flatten(flatten({a}))))  + len(list_distinct(flatten(flatten({b})))))"
    return f"""CASE WHEN {a}_root = {b}_root THEN 1.0::DOUBLE WHEN {both} = 0 THEN 0.0::DOUBLE ELSE
        2.0::DOUBLE * len(list_intersect(list_distinct(flatten(flatten({a}))), list_distinct(flatten(flatten({b}))))) / {both} END"""


_NAMES = ("own", "edit", "next")
FINGERPRINTS = f"""
WITH o AS (SELECT doc_id, coalesce(text, '') AS own_text, lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC) AS follows FROM documents),
e AS (SELECT doc_id, own_text, coalesce(follows, (SELECT coalesce(text, '') FROM documents ORDER BY doc_id DESC LIMIT 1)) AS next_text FROM o),
x AS (SELECT *, left(own_text, length(own_text) - length(own_text) // 3) || left(next_text, length(own_text) // 3) AS edit_text FROM e),
t AS (SELECT *, {', '.join(f"{_tree(f'{n}_text')} AS {n}" for n in _NAMES)} FROM x),
p AS (SELECT *, {', '.join(f"list_transform({n}, lambda s: list_transform(s, lambda q: sha256(array_to_string(q, ',')))) AS {n}_par" for n in _NAMES)} FROM t),
r AS (SELECT *, {', '.join(f"sha256(array_to_string(list_transform({n}_par, lambda s: sha256(array_to_string(s, ','))), ',')) AS {n}_root" for n in _NAMES)},
      flatten(own_par) AS a, flatten(edit_par) AS b FROM p)
SELECT doc_id, CAST(length(own_text) AS BIGINT) AS n_chars, sha256(edit_text) AS edited_sha256, own_root AS fingerprint,
       edit_root AS edited_fingerprint, {_near('own', 'edit')} AS near_edited, {_near('own', 'next')} AS near_next,
       CAST(coalesce(list_filter(generate_series(1, greatest(len(a), len(b))), lambda i: a[i] IS DISTINCT FROM b[i])[1] - 1, -1) AS BIGINT) AS changed_from
FROM r
"""

_HOST = f"translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}')"


def _node(rest: str) -> str:
    bare = f"regexp_replace({rest}, '#.*$', '', 's')"
    kept = f"""array_to_string(list_filter(string_split(regexp_extract({bare}, '\\?(.*)$', 1, 's'), '&'),
        lambda q: NOT regexp_matches(q, '^(?:utm_[a-z]+|ref|gclid|fbclid)=') AND q <> ''), '&')"""
    return f"""(translate(regexp_extract({bare}, '^([^/?]*)([^?]*)', 1), '{_UPPER}', '{_LOWER}') || regexp_extract({bare}, '^([^/?]*)([^?]*)', 2)
        || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END)"""


_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}', '{h}{p}')" for v, h, p in _RULES)
URL_FILTER = f"""
WITH RECURSIVE u AS (SELECT row_number() OVER () AS k, page_id, coalesce(html, '') AS html,
           CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT k, page_id, html, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, {_node('rest')} AS node FROM u),
r(verdict, rule_host, rule_path, rule) AS (VALUES {_RULE_ROWS}),
m AS (SELECT k, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
      FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY k),
l AS (SELECT node AS a, unnest([
        regexp_extract(regexp_extract(html, '(?i)<link[^>]*rel=["'']?canonical["''][^>]*>'), '(?i)href=["'']([^"'']+)["'']', 1),
        regexp_extract(html, '(?i)<meta[^>]*http-equiv=["'']?refresh["'']?[^>]*url=[''"]?([^"''>\\s]+)', 1)]) AS href, host FROM p WHERE host <> ''),
far AS (SELECT a, CASE WHEN contains(href, '://') THEN string_split(href, '://')[-1] WHEN starts_with(href, '/') THEN host || href END AS rest FROM l),
e AS (SELECT a, {_node('rest')} AS b FROM far WHERE rest IS NOT NULL
      UNION SELECT node, regexp_replace(regexp_replace(node, '^(?:www|m)\\.', ''), '(?:/index)?\\.html?($|\\?)', '\\1') FROM p WHERE host <> ''),
both_ways AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach(node, other) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
roots AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
j AS (SELECT p.page_id, p.host, p.path, m.rule, m.verdict, roots.component FROM p LEFT JOIN m USING (k) LEFT JOIN roots ON p.node = roots.node AND p.host <> ''),
c AS (SELECT component, bool_or(verdict = 'allow') AS allowed FROM j WHERE component IS NOT NULL AND verdict IS NOT NULL GROUP BY component)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN NOT allowed THEN 'block' END, 'allow') AS verdict, j.component
FROM j LEFT JOIN c ON j.component = c.component
"""


_JSON = "CAST(to_json({}) AS VARCHAR)".format
TOOL_CALLS = f"""
WITH RECURSIVE t AS (SELECT *, coalesce(length(text), 0) AS n FROM conversations),
c AS (SELECT conv_id, turn, n, text, 'c' || turn AS call_id,
        CASE WHEN n % 11 = 0 THEN 'draw' WHEN n % 3 = 0 THEN 'note' ELSE 'search' END AS name, n % 19 = 0 AS broken,
        CASE WHEN n % 7 = 0 THEN 'c' || (turn + 2) WHEN n % 5 < 2 AND turn > 1 THEN 'c' || (turn - 2) END AS needs FROM t WHERE role = 'assistant'),
r AS (SELECT conv_id, turn, 'c' || (turn - 1) AS call_id, text AS content FROM t WHERE role = 'user'),
e AS (SELECT c.conv_id, c.call_id, c.turn, k.call_id AS needs, k.turn AS at FROM c JOIN c AS k ON c.conv_id = k.conv_id AND c.needs = k.call_id WHERE NOT c.broken),
above(conv_id, call_id, top) AS (SELECT conv_id, call_id, needs FROM e
        UNION SELECT above.conv_id, above.call_id, e.needs FROM above JOIN e ON above.conv_id = e.conv_id AND above.top = e.call_id),
loops AS (SELECT conv_id, call_id FROM above WHERE call_id = top),
stuck AS (SELECT conv_id, call_id FROM loops UNION SELECT a.conv_id, a.call_id FROM above a JOIN loops l ON a.conv_id = l.conv_id AND a.top = l.call_id),
value(conv_id, call_id, position, hop) AS (SELECT conv_id, call_id, turn, 0 FROM c ANTI JOIN stuck USING (conv_id, call_id)
        UNION SELECT e.conv_id, e.call_id, greatest(v.position, e.turn), CASE WHEN v.position >= e.turn THEN v.hop + 1 ELSE 0 END
        FROM value v JOIN e ON v.conv_id = e.conv_id AND v.call_id = e.needs ANTI JOIN stuck s ON e.conv_id = s.conv_id AND e.call_id = s.call_id),
best AS (SELECT conv_id, call_id, max({{'p': position, 'h': hop}}) AS b FROM value GROUP BY ALL),
j AS (SELECT c.*, b.b.p AS position, b.b.h AS hop, s.call_id IS NOT NULL AS cyclic, r.call_id IS NOT NULL AS answered, r.content,
        c.needs IS NOT NULL AND NOT c.broken AND k.call_id IS NULL AS lost
      FROM c LEFT JOIN best b ON c.conv_id = b.conv_id AND c.call_id = b.call_id LEFT JOIN stuck s ON c.conv_id = s.conv_id AND c.call_id = s.call_id
      LEFT JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id LEFT JOIN c AS k ON c.conv_id = k.conv_id AND c.needs = k.call_id)
SELECT conv_id, call_id, turn, name, CAST(coalesce(position, -1) AS BIGINT) AS position, CAST(coalesce(hop, -1) AS BIGINT) AS hop,
       array_to_string(list_filter([
           CASE WHEN broken THEN 'arguments' WHEN name = 'draw' THEN 'tool' END,
           CASE WHEN NOT broken AND name <> 'draw' AND text IS NULL THEN 'missing:query' END,
           CASE WHEN NOT broken AND name <> 'draw' AND n % 17 = 0 THEN 'surplus:extra' END,
           CASE WHEN NOT broken AND name <> 'draw' AND n % 13 = 0 THEN 'type:limit' END,
           CASE WHEN lost THEN 'reference:' || needs END, CASE WHEN cyclic THEN 'cycle' END, CASE WHEN NOT answered THEN 'no result' END],
           lambda x: x IS NOT NULL), ',') AS problems,
       '{{"arguments":{{' || CASE WHEN broken THEN '' ELSE coalesce('"after":"$' || needs || '",', '') || CASE WHEN n % 17 = 0 THEN '"extra":1,' ELSE '' END
           || '"limit":' || CASE WHEN n % 13 = 0 THEN '"' || n || '"' ELSE n::VARCHAR END || coalesce(',"query":' || {_JSON('text')}, '') END
           || '}},"id":' || {_JSON('call_id')} || ',"name":"' || name || '","result":' || coalesce({_JSON('content')}, 'null') || '}}' AS line
FROM j
UNION ALL
SELECT r.conv_id, r.call_id, r.turn, NULL, -1, -1, 'no call',
       '{{"arguments":{{}},"id":' || {_JSON('r.call_id')} || ',"name":null,"result":' || coalesce({_JSON('content')}, 'null') || '}}'
FROM r ANTI JOIN c ON r.conv_id = c.conv_id AND r.call_id = c.call_id
"""
