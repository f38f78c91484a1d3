"""Validation, JSON repair, requests, sessions, permissions and audit over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom import config
from alertloom.catalog.base import Tables, query, with_alerts
from alertloom.operators import access as ac
from alertloom.operators import audit as au
from alertloom.operators import quality as qu
from alertloom.session import spread

big = lambda c: F.col(c).cast("bigint").alias(c)
r6 = lambda c: F.round(c, 6).alias(c)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- JSON ------------------------------------------------------------------------

MESSY = r"""CASE event_id % 8
  WHEN 1 THEN concat('Result: ```json', chr(10), props, chr(10), '``` done')
  WHEN 2 THEN concat('```', chr(10), props, chr(10), '```')
  WHEN 3 THEN concat('note ', substr(props, 1, length(props) - 1), ', }')
  WHEN 4 THEN replace(props, '"', chr(39))
  WHEN 5 THEN concat(substr(props, 1, length(props) - 1), ', "m": "a', chr(10), 'b"}')
  WHEN 6 THEN concat('answer {k: ', event_id, ', } end')
  WHEN 7 THEN concat('no data for ', event_id)
  ELSE props END"""


@query("src04_repair_json", """SELECT event_id, CASE event_id % 8 WHEN 3 THEN substr(props, 1, length(props) - 1) || ' }'
  WHEN 5 THEN substr(props, 1, length(props) - 1) || ', "m": "a b"}' WHEN 6 THEN '{"k": ' || event_id || ' }'
  WHEN 7 THEN '' ELSE props END AS repaired FROM events""")
def _(t: Tables):
    messy = t.events.select("event_id", F.expr(MESSY).alias("raw"))
    return messy.select("event_id", F.coalesce(qu.repair_json(F.col("raw")), F.lit("")).alias("repaired"))


@query("f18_json_depth", """SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN least(11, user_id % 14) WHEN event_id % 3 = 1 THEN least(11, user_id % 14 + 1)
  ELSE 2 END AS BIGINT) AS depth FROM events""")
def _(t: Tables):
    n = F.col("user_id") % 14
    nested = F.when(F.col("event_id") % 3 == 0, F.concat(F.repeat(F.lit('{"a{": '), n), F.lit("1"), F.repeat(F.lit("}"), n))).when(
        F.col("event_id") % 3 == 1, F.concat(F.repeat(F.lit('{"a": '), n), F.col("props"), F.repeat(F.lit("}"), n))).otherwise(
        F.concat(F.lit('{"a": [{}, "]]\\"{"], "b": '), F.col("props"), F.lit("}")))
    return t.events.select("event_id", qu.json_depth(nested).cast("bigint").alias("depth"))


# --- validation -------------------------------------------------------------------------

@query("f14_record_checks", """
WITH r AS (SELECT doc_id, text, [ 'cluster', 'daily', 'weekly', 'monthly', 'quarterly', 'yearly'][doc_id % 6 + 1] AS level, n_chars / 5000 AS quality,
  doc_id % 14 AS month, doc_id % 5 AS quarter FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN quality NOT BETWEEN 0 AND 1 THEN 'quality' END, CASE WHEN month NOT BETWEEN 1 AND 12 THEN 'month' END,
  CASE WHEN quarter NOT BETWEEN 1 AND 4 THEN 'quarter' END, CASE WHEN level = 'yearly' THEN 'level' END,
  CASE WHEN (level = 'cluster' AND length(text) NOT BETWEEN 50 AND 2000) OR (level = 'daily' AND length(text) NOT BETWEEN 100 AND 5000)
    OR (level = 'weekly' AND length(text) NOT BETWEEN 200 AND 8000) OR (level = 'monthly' AND length(text) NOT BETWEEN 500 AND 12000)
    OR (level = 'quarterly' AND length(text) NOT BETWEEN 800 AND 15000) THEN 'text_length' END) AS failed FROM r""")
def _(t: Tables):
    levels = F.array(*[F.lit(x) for x in ("cluster", "daily", "weekly", "monthly", "quarterly", "yearly")])
    failed = qu.record_checks(levels[(F.col("doc_id") % 6).cast("int")], F.col("text"), F.col("n_chars") / 5000,
                              F.col("doc_id") % 14, F.col("doc_id") % 5)
    return t.documents.select("doc_id", F.array_join(failed, ",").alias("failed"))


PAGE_FIELDS = """SELECT page_id, url, html, CAST(page_id * 3 AS {0}) AS number, CASE WHEN page_id % 9 = 0 THEN 'x' ELSE CAST(page_id AS {0}) END AS amount,
  CASE page_id % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'off' ELSE 'maybe' END AS flag, concat('user', page_id, '@mail', CASE WHEN page_id % 4 = 0 THEN '' ELSE '.org' END) AS email,
  concat('10.0.', page_id % 300, '.1') AS ip,
  concat(substr(md5(url), 1, 8), '-', substr(md5(url), 9, 4), '-', substr(md5(url), 13, 4), '-', substr(md5(url), 17, 4), '-', substr(md5(url), 21, 12)) AS uid,
  concat('{{"a": ', page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE '}}' END) AS body,
  CASE page_id % 3 WHEN 0 THEN concat('../f', page_id) WHEN 1 THEN concat('f ', page_id) ELSE concat('f-', page_id, '.log') END AS file,
  CASE WHEN page_id % 7 = 0 THEN NULL ELSE concat('src', page_id % 4) END AS source FROM {1}"""

RULES = [
    qu.Rule("url", "url"), qu.Rule("html", "string", max_length=2000), qu.Rule("number", "integer", min_value=10, max_value=600),
    qu.Rule("amount", "float", max_value=200), qu.Rule("flag", "boolean"), qu.Rule("email", "email"), qu.Rule("ip", "ip_address"),
    qu.Rule("uid", "uuid"), qu.Rule("body", "json"), qu.Rule("html", "sql_safe"), qu.Rule("file", "filename"),
    qu.Rule("source", "string", required=True, allowed=["src0", "src1", "src2"]),
    qu.Rule("source", "regex", pattern="src[0-2]"),
    qu.Rule("url", "custom", check=lambda c: F.length(c) < 60),
]


@query("f15_validate_columns", f"""WITH p AS ({PAGE_FIELDS.format('VARCHAR', 'pages')}),
e AS (SELECT *, list_filter([
  CASE WHEN NOT regexp_matches(url, {lit(config.VALID_URL)}) THEN 'url: invalid URL format' END,
  CASE WHEN length(html) > 2000 THEN 'html: too long' END, CASE WHEN length(html) > 10000 THEN 'html: exceeds system limit' END,
  CASE WHEN CAST(number AS BIGINT) < 10 THEN 'number: too small' END, CASE WHEN CAST(number AS BIGINT) > 600 THEN 'number: too large' END,
  CASE WHEN try_cast(amount AS DOUBLE) IS NULL THEN 'amount: not a valid number' END, CASE WHEN try_cast(amount AS DOUBLE) > 200 THEN 'amount: too large' END,
  CASE WHEN flag = 'maybe' THEN 'flag: not a valid boolean' END, CASE WHEN NOT regexp_matches(lower(email), {lit(config.VALID_EMAIL)}) THEN 'email: invalid email format' END,
  CASE WHEN NOT regexp_matches(ip, {lit(config.VALID_IPV4)}) THEN 'ip: invalid IP address format' END,
  CASE WHEN NOT regexp_matches(uid, {lit(config.VALID_UUID)}) THEN 'uid: invalid UUID format' END,
  CASE WHEN NOT json_valid(body) THEN 'body: invalid JSON' END,
  CASE WHEN regexp_matches(html, {lit(config.SQL_INJECTION)}) THEN 'html: potential SQL injection' END,
  CASE page_id % 3 WHEN 0 THEN 'file: path traversal in filename' WHEN 1 THEN 'file: invalid filename format' END,
  CASE WHEN source IS NULL THEN 'source: required' END, CASE WHEN source = 'src3' THEN 'source: not allowed' END,
  CASE WHEN source = 'src3' THEN 'source: does not match required pattern' END, CASE WHEN length(url) >= 60 THEN 'url: custom validation failed' END], lambda x: x IS NOT NULL) AS errs FROM p)
SELECT page_id, array_to_string(errs, '|') AS errors, CAST(len(errs) AS BIGINT) AS n_errors, 'html: HTML-escaped' AS warnings,
  md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;')) AS clean_md5 FROM e""")
def _(t: Tables):
    t.pages.createOrReplaceTempView("pages_to_check")
    rows = t.spark.sql(PAGE_FIELDS.format("STRING", "pages_to_check"))
    return qu.validate(rows, RULES).select("page_id", F.array_join("errors", "|").alias("errors"), F.size("errors").cast("bigint").alias("n_errors"),
                          F.array_join("warnings", "|").alias("warnings"), F.md5("html_clean").alias("clean_md5"))


ROWS = """SELECT 'page' AS kind, page_id AS id, html AS body FROM {0} UNION ALL SELECT 'doc', doc_id, text FROM {1}"""


@query("f16_scan_injection", f"""WITH r AS ({ROWS.format('pages', 'documents')}), j AS (SELECT *, CAST(json_object('id', id, 'body', body) AS VARCHAR) AS j FROM r)
SELECT kind, id, regexp_matches(j, {lit(config.XSS)}) AS xss, regexp_matches(j, {lit(config.COMMAND_INJECTION)}) AS command_injection,
  regexp_matches(j, {lit(config.PATH_TRAVERSAL)}) AS path_traversal, regexp_matches(body, {lit(config.SQL_INJECTION)}) AS sql_injection FROM j""")
def _(t: Tables):
    rows = t.pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("body")).unionByName(
        t.documents.select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body")))
    return spread(rows).select("kind", "id", *qu.scan_injection(F.to_json(F.struct("id", "body")), F.col("body")))


@query("f17_sanitize_html", """SELECT page_id, md5(s) AS html_md5, length(s) AS n FROM (SELECT page_id,
  replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS s FROM pages) p""")
def _(t: Tables):
    clean = spread(t.pages.select("page_id", "html")).select("page_id", qu.sanitize_html(F.col("html")).alias("s"))
    return clean.select("page_id", F.md5("s").alias("html_md5"), F.length("s").cast("bigint").alias("n"))


# --- requests -----------------------------------------------------------------------------

REQUESTS = """requests AS (SELECT event_id AS request_id, epoch_us(ts) AS ts_us, '10.0.0.' || (user_id % 200) AS ip,
  CASE WHEN event_id % 17 = 0 THEN '/a/../b' ELSE '/' || event_type END AS path, CASE WHEN event_id % 5 = 0 THEN 'POST' WHEN event_id % 23 = 0 THEN 'TRACE' ELSE 'GET' END AS method,
  CASE WHEN event_id % 31 = 0 THEN 'SQLMap/1.0' WHEN event_id % 37 = 0 THEN 'nmap' ELSE 'Mozilla' END AS user_agent,
  CAST(value * 30000 AS BIGINT) AS length, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value / 20 AS duration FROM events)"""


def requests(t: Tables):
    e, n = t.events, F.col("event_id")
    return e.select(
        n.alias("request_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.concat(F.lit("10.0.0."), F.col("user_id") % 200).alias("ip"),
        F.when(n % 17 == 0, "/a/../b").otherwise(F.concat(F.lit("/"), "event_type")).alias("path"),
        F.when(n % 5 == 0, "POST").when(n % 23 == 0, "TRACE").otherwise("GET").alias("method"),
        F.when(n % 31 == 0, "SQLMap/1.0").when(n % 37 == 0, "nmap").otherwise("Mozilla").alias("user_agent"),
        F.round(F.col("value") * 30000).cast("bigint").alias("length"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        (F.col("value") / 20).alias("duration"))


FLAGS = """flags AS (SELECT *, CASE WHEN ip IN ('10.0.0.7', '10.0.0.8') THEN 'ip_blocked' WHEN length > 10485760 THEN 'request_too_large'
  WHEN user_agent <> 'Mozilla' THEN 'suspicious_user_agent' WHEN path = '/a/../b' THEN 'path_traversal_attempt' WHEN method = 'TRACE' THEN 'method_not_allowed'
  ELSE 'ok' END AS verdict, duration > 5 AS slow, status >= 400 AS failed FROM requests)"""


def flags(t: Tables):
    return ac.request_flags(requests(t), ["10.0.0.7", "10.0.0.8"], ["GET", "POST"])


@query("w08_request_flags", f"WITH {REQUESTS}, {FLAGS} SELECT request_id, verdict, slow, failed FROM flags")
def _(t: Tables):
    return flags(t).select("request_id", "verdict", "slow", "failed")


# Requests by the rate limit of their address: 2 in six hours, 1 in ten minutes; blocked for good after the fourth violation.
RATED = f"""{REQUESTS}, q AS (SELECT request_id, ip, ts_us AS t, row_number() OVER (PARTITION BY ip ORDER BY ts_us, request_id) AS rn FROM requests),
walk AS (
  SELECT ip, 0::BIGINT AS rn, NULL::BIGINT AS request_id, false AS accepted, CAST([] AS BIGINT[]) AS acc, 0 AS strikes FROM (SELECT DISTINCT ip FROM q) x
  UNION ALL
  SELECT ip, rn, request_id, passed, CASE WHEN passed THEN list_append(kept, t) ELSE kept END, strikes + CASE WHEN passed THEN 0 ELSE 1 END FROM (
    SELECT *, len(kept) < 2 AND len(list_filter(kept, lambda a: a > t - 600000000)) < 1 AS passed FROM (
      SELECT q.ip, q.rn, q.request_id, q.t, w.strikes, list_filter(w.acc, lambda a: a > q.t - 21600000000) AS kept FROM walk w JOIN q ON q.ip = w.ip AND q.rn = w.rn + 1) k) p),
rated AS (SELECT request_id, ip, CASE WHEN strikes - CASE WHEN accepted THEN 0 ELSE 1 END > 3 THEN 'blocked' WHEN accepted THEN 'pass' ELSE 'limited' END AS rate FROM walk WHERE rn > 0)"""


def rated(asked):
    decided = ac.rate_limit(asked.select("request_id", "ip", "ts_us"), limit=2, window_s=6 * 3600, burst=1, burst_s=600, chunk_s=24 * 3600)
    return ac.rate_verdicts(decided, max_violations=3).select("request_id", "ip", "verdict")


@query("w05_rate_verdicts", f"WITH RECURSIVE {RATED} SELECT ip, count(*) AS requests, count(*) FILTER (WHERE rate = 'limited') AS violations, count(*) FILTER (WHERE rate = 'blocked') > 0 AS blocked FROM rated GROUP BY 1")
def _(t: Tables):
    return ac.violations_per_ip(rated(requests(t)))


@query("a37_request_stats", f"""WITH RECURSIVE {RATED}, {FLAGS}, v AS (SELECT f.ip, rate, CASE WHEN rate = 'blocked' THEN 'ip_blocked' ELSE verdict END AS verdict FROM flags f JOIN rated USING (request_id))
SELECT count(*) AS total, count(*) FILTER (WHERE verdict NOT IN ('ok', 'suspicious_user_agent')) AS blocked,
  count(*) FILTER (WHERE rate = 'limited') AS limited, count(*) FILTER (WHERE verdict = 'suspicious_user_agent') AS suspicious,
  round(count(*) FILTER (WHERE verdict NOT IN ('ok', 'suspicious_user_agent')) / count(*) * 100, 6) AS percent_blocked, count(DISTINCT ip) AS active_ips FROM v""")
def _(t: Tables):
    return ac.request_stats(ac.with_rates(flags(t), rated(requests(t)))).withColumn("percent_blocked", F.round("percent_blocked", 6))


@query("j11_ip_lists", f"""WITH RECURSIVE {RATED}, p AS (SELECT ip, count(*) AS requests, count(*) FILTER (WHERE rate = 'limited') AS violations FROM rated GROUP BY 1),
b AS (SELECT DISTINCT ip FROM requests WHERE user_agent = 'nmap' AND length > 3000000), a AS (SELECT DISTINCT ip FROM requests WHERE method = 'GET' AND path <> '/view')
SELECT ip, requests, violations, CASE WHEN ip IN (FROM b) THEN 'block_list' WHEN ip NOT IN (FROM a) THEN 'not_allowed' WHEN violations > 3 THEN 'violations' ELSE 'pass' END AS verdict FROM p""")
def _(t: Tables):
    r = requests(t)
    return ac.ip_verdicts(rated(r).select("ip", (F.col("verdict") == "limited").alias("violation")), r.where("user_agent = 'nmap' AND length > 3000000"),
                          r.where("method = 'GET' AND path <> '/view'"), max_violations=3)


ACCEPTANCE = """WITH RECURSIVE e AS (
  SELECT event_id, event_type AS ip, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
walk AS (
  SELECT ip, 0::BIGINT AS rn, NULL::BIGINT AS event_id, false AS accepted, CAST([] AS BIGINT[]) AS acc FROM (SELECT DISTINCT ip FROM e) x
  UNION ALL
  SELECT ip, rn, event_id, passed, CASE WHEN passed THEN list_append(kept, t) ELSE kept END FROM (
    SELECT *, len(kept) < 8 AND len(list_filter(kept, lambda a: a > t - 600000000)) < 2 AS passed FROM (
      SELECT e.ip, e.rn, e.event_id, e.t, list_filter(w.acc, lambda a: a > e.t - 3600000000) AS kept FROM walk w JOIN e ON e.ip = w.ip AND e.rn = w.rn + 1) k) p)"""


@query("w05_rate_limit", ACCEPTANCE + " SELECT event_id AS request_id, ip, accepted FROM walk WHERE rn > 0")
def _(t: Tables):
    asked = t.events.select(F.col("event_id").alias("request_id"), F.col("event_type").alias("ip"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))
    return ac.rate_limit(asked, limit=8, window_s=3600, burst=2, burst_s=600, chunk_s=6 * 3600).select("request_id", "ip", "accepted")


@query("w06_lockout", """WITH f AS (SELECT event_type AS user_id, epoch_us(ts) AS ts_us FROM events),
c AS (SELECT user_id, ts_us, count(*) OVER (PARTITION BY user_id ORDER BY ts_us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n FROM f)
SELECT DISTINCT user_id, ts_us, n FROM c WHERE n >= 5""")
def _(t: Tables):
    failures = t.events.select(F.col("event_type").alias("user_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))
    return ac.lockouts(failures, minutes=60)


# --- sessions -------------------------------------------------------------------------------

SESSIONS = """sessions AS (SELECT user_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id, user_id, epoch_us(min(ts)) AS created_at,
  epoch_us(min(ts)) + 28800000000 AS expires_at, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'revoked' ELSE 'active' END AS state FROM events GROUP BY user_id, CAST(ts AS DATE))"""
MIDDAY = 1705320000000000  # 2024-01-15 12:00 UTC


def sessions(t: Tables):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    day = F.to_date("ts")
    return t.events.groupBy("user_id", day.alias("day")).agg(
        F.min(at).alias("created_at"), F.count_if(F.col("event_type") == "error").alias("errors")).select(
        F.concat("user_id", F.lit("/"), F.col("day").cast("string")).alias("session_id"), "user_id", "created_at",
        (F.col("created_at") + config.SESSION_ABSOLUTE_HOURS * 3_600_000_000).alias("expires_at"),
        F.when(F.col("errors") > 0, "revoked").otherwise("active").alias("state"))


@query("f19_live_sessions", f"WITH {SESSIONS} SELECT session_id, user_id FROM sessions WHERE state = 'active' AND expires_at > {MIDDAY}")
def _(t: Tables):
    return ac.live_sessions(sessions(t), F.lit(MIDDAY)).select("session_id", "user_id")


@query("a38_session_stats", f"""WITH {SESSIONS} SELECT count(*) AS total, count(*) FILTER (WHERE state = 'active' AND expires_at > {MIDDAY}) AS active,
  count(*) FILTER (WHERE state = 'active' AND expires_at <= {MIDDAY}) AS expired, count(*) FILTER (WHERE state = 'revoked') AS revoked, count(DISTINCT user_id) AS users,
  count(DISTINCT CASE WHEN state = 'active' AND expires_at > {MIDDAY} THEN user_id END) AS active_users,
  round(count(*) FILTER (WHERE state = 'active' AND expires_at > {MIDDAY}) / count(DISTINCT CASE WHEN state = 'active' AND expires_at > {MIDDAY} THEN user_id END), 6) AS active_per_user FROM sessions""")
def _(t: Tables):
    return ac.session_stats(sessions(t), F.lit(MIDDAY)).withColumn("active_per_user", F.round("active_per_user", 6))


@query("w07_session_limit", f"""WITH {SESSIONS} SELECT session_id, user_id FROM sessions
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, session_id) > 5""")
def _(t: Tables):
    return ac.session_limit(sessions(t)).select("session_id", "user_id")


@query("st10_session_consistency", (CONSISTENCY := """WITH a AS (SELECT user_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id, event_id, epoch_us(ts) AS ts_us,
  '10.0.' || (user_id % 9) || '.' || CASE WHEN event_id % 11 = 0 THEN 2 ELSE 1 END AS ip, CASE WHEN event_id % 13 = 0 THEN 'curl' ELSE 'Mozilla' END AS user_agent FROM events),
f AS (SELECT session_id, arg_min(ip, (ts_us, event_id)) AS fip, arg_min(user_agent, (ts_us, event_id)) AS fua FROM a GROUP BY 1)
SELECT session_id, min(ts_us) AS closed_us, arg_min(CASE WHEN ip <> fip THEN 'ip_mismatch' ELSE 'user_agent_mismatch' END, (ts_us, event_id)) AS reason, count(*) AS changes
FROM a JOIN f USING (session_id) WHERE ip <> fip OR user_agent <> fua GROUP BY 1"""))
def _(t: Tables):
    return ac.session_consistency(session_activity(t.events))


def session_activity(events):
    n = F.col("event_id")
    return events.select(
        F.concat("user_id", F.lit("/"), F.to_date("ts").cast("string")).alias("session_id"), "ts", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.concat(F.lit("10.0."), F.col("user_id") % 9, F.lit("."), F.when(n % 11 == 0, 2).otherwise(1)).alias("ip"),
        F.when(n % 13 == 0, "curl").otherwise("Mozilla").alias("user_agent"))


# --- permissions ----------------------------------------------------------------------------

PERMISSIONS = """parents AS (SELECT 'region-' || n_regionkey AS parent, 'nation-' || n_nationkey AS child FROM nation UNION SELECT 'all', 'region-' || r_regionkey FROM region),
perms AS (SELECT 'nation-' || n_nationkey AS role, CASE n_nationkey % 5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '4-NOT SPECIFIED' ELSE '5-LOW' END AS resource, 'write' AS action FROM nation
  UNION ALL SELECT 'region-' || r_regionkey, CASE r_regionkey % 2 WHEN 0 THEN '2-HIGH' ELSE '4-NOT SPECIFIED' END, CASE r_regionkey % 3 WHEN 0 THEN 'admin' ELSE 'read' END FROM region
  UNION ALL SELECT 'all', '5-LOW', 'read'),
active AS (SELECT c_custkey AS user_id, 'nation-' || c_nationkey AS role FROM customer WHERE c_acctbal >= 0),
roles AS (SELECT DISTINCT role, role AS source FROM perms UNION SELECT child, parent FROM parents UNION SELECT a.child, b.parent FROM parents a JOIN parents b ON a.parent = b.child),
granted AS (SELECT DISTINCT user_id, resource, action FROM active JOIN roles USING (role) JOIN perms ON perms.role = roles.source)"""


def granted(t: Tables):
    pick = lambda key, *names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col(key) % len(names) + 1).cast("int"))
    nation = F.concat(F.lit("nation-"), "n_nationkey")
    region = F.concat(F.lit("region-"), "r_regionkey")
    parents = t.nation.select(F.concat(F.lit("region-"), "n_regionkey").alias("parent"), nation.alias("child")).unionByName(
        t.region.select(F.lit("all").alias("parent"), region.alias("child")))
    perms = t.nation.select(nation.alias("role"), pick("n_nationkey", "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW").alias("resource"), F.lit("write").alias("action")).unionByName(
        t.region.select(region.alias("role"), pick("r_regionkey", "2-HIGH", "4-NOT SPECIFIED").alias("resource"), F.when(F.col("r_regionkey") % 3 == 0, "admin").otherwise("read").alias("action"))).unionByName(
        t.region.where("r_regionkey = 0").select(F.lit("all").alias("role"), F.lit("5-LOW").alias("resource"), F.lit("read").alias("action")))
    people = t.customer.select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("nation-"), "c_nationkey").alias("role"),
                               F.when(F.col("c_acctbal") < 0, 1).otherwise(3).alias("expires_at"))
    return ac.effective_permissions(people, parents, perms, F.lit(2))


@query("j10_effective_permissions", f"WITH {PERMISSIONS} SELECT user_id, resource, action FROM granted")
def _(t: Tables):
    return granted(t)


@query("j10_access_review", f"""WITH {PERMISSIONS}, r AS (SELECT o_orderkey, o_custkey AS user_id, o_orderpriority AS resource,
  CASE o_orderstatus WHEN 'O' THEN 'read' WHEN 'F' THEN 'write' ELSE 'delete' END AS action FROM orders)
SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM granted g WHERE g.user_id = r.user_id AND g.resource = r.resource AND
  (g.action = 'admin' OR g.action = r.action OR (g.action = 'write' AND r.action = 'read'))) THEN 'allow' ELSE 'deny' END AS decision FROM r""")
def _(t: Tables):
    status = F.col("o_orderstatus")
    asked = t.orders.select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("resource"),
                            F.when(status == "O", "read").when(status == "F", "write").otherwise("delete").alias("action"))
    return ac.access_review(asked, granted(t)).select("o_orderkey", "decision")


# Grants of nations hold for one year or for all, and some of them under conditions; requests name both or none.
SCOPED = """sperms AS (SELECT 'nation-' || n_nationkey AS role, CASE n_nationkey % 5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '4-NOT SPECIFIED' ELSE '5-LOW' END AS resource,
    CASE WHEN n_nationkey % 7 = 0 THEN 'admin' ELSE 'write' END AS action, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE CAST(1992 + n_nationkey % 7 AS VARCHAR) END AS resource_id,
    CASE WHEN n_nationkey % 3 = 0 THEN [] WHEN n_nationkey % 3 = 1 THEN ['status=O'] ELSE ['status=F', 'tier=low'] END AS conditions FROM nation
  UNION ALL SELECT 'region-' || r_regionkey, '3-MEDIUM', 'read', CAST(1992 + r_regionkey AS VARCHAR), ['tier=low'] FROM region),
srole AS (SELECT DISTINCT role, role AS source FROM sperms UNION SELECT child, parent FROM parents UNION SELECT a.child, b.parent FROM parents a JOIN parents b ON a.parent = b.child),
sgrant AS (SELECT DISTINCT user_id, resource, action, resource_id, conditions FROM active JOIN srole USING (role) JOIN sperms ON sperms.role = srole.source)"""


def scoped_grants(t: Tables):
    nation, region = F.concat(F.lit("nation-"), "n_nationkey"), F.concat(F.lit("region-"), "r_regionkey")
    pick = lambda key, *names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col(key) % len(names) + 1).cast("int"))
    rule = lambda *pairs: F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    third = F.col("n_nationkey") % 3
    perms = t.nation.select(
        nation.alias("role"), pick("n_nationkey", "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW").alias("resource"),
        F.when(F.col("n_nationkey") % 7 == 0, "admin").otherwise("write").alias("action"),
        F.when(F.col("n_nationkey") % 2 != 0, (1992 + F.col("n_nationkey") % 7).cast("string")).alias("resource_id"),
        F.when(third == 1, rule(("status", "O"))).when(third == 2, rule(("status", "F"), ("tier", "low"))).alias("conditions")).unionByName(
        t.region.select(region.alias("role"), F.lit("3-MEDIUM").alias("resource"), F.lit("read").alias("action"),
                        (1992 + F.col("r_regionkey")).cast("string").alias("resource_id"), rule(("tier", "low")).alias("conditions")))
    parents = t.nation.select(F.concat(F.lit("region-"), "n_regionkey").alias("parent"), nation.alias("child")).unionByName(
        t.region.select(F.lit("all").alias("parent"), region.alias("child")))
    people = t.customer.select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("nation-"), "c_nationkey").alias("role"),
                               F.when(F.col("c_acctbal") < 0, 1).otherwise(3).alias("expires_at"))
    return ac.effective_permissions(people, parents, perms, F.lit(2))


@query("j10_scoped_permissions", f"WITH {PERMISSIONS}, {SCOPED} SELECT user_id, resource, action, resource_id, array_to_string(list_sort(conditions), ',') AS conditions FROM sgrant")
def _(t: Tables):
    pair = lambda e: F.concat(e["key"], F.lit("="), e["value"])
    return scoped_grants(t).withColumn("conditions", F.coalesce(F.array_join(F.transform("conditions", pair), ","), F.lit("")))


@query("j10_scoped_review", f"""WITH {PERMISSIONS}, {SCOPED}, r AS (SELECT o_orderkey, o_custkey AS user_id, o_orderpriority AS resource,
  CASE WHEN o_orderkey % 11 = 0 THEN 'delete' WHEN o_orderkey % 3 = 0 THEN 'read' ELSE 'write' END AS action,
  CASE WHEN o_orderkey % 4 <> 0 THEN CAST(year(o_orderdate) AS VARCHAR) END AS resource_id,
  CASE o_orderkey % 3 WHEN 0 THEN [] WHEN 1 THEN ['status=' || o_orderstatus] ELSE ['status=' || o_orderstatus, CASE WHEN o_totalprice < 150000 THEN 'tier=low' ELSE 'tier=high' END] END AS asked FROM orders)
SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM sgrant g WHERE g.user_id = r.user_id AND g.resource = r.resource AND
  (g.action = 'admin' OR g.action = r.action OR (g.action = 'write' AND r.action = 'read')) AND (r.resource_id IS NULL OR g.resource_id = r.resource_id)
  AND (len(asked) = 0 OR len(conditions) = 0 OR list_has_all(conditions, asked))) THEN 'allow' ELSE 'deny' END AS decision FROM r""")
def _(t: Tables):
    key = F.col("o_orderkey")
    status = F.create_map(F.lit("status"), F.col("o_orderstatus"))
    tier = F.create_map(F.lit("tier"), F.when(F.col("o_totalprice") < 150000, "low").otherwise("high"))
    asked = t.orders.select(
        "o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("resource"),
        F.when(key % 11 == 0, "delete").when(key % 3 == 0, "read").otherwise("write").alias("action"),
        F.when(key % 4 != 0, F.year("o_orderdate").cast("string")).alias("resource_id"),
        F.when(key % 3 == 1, status).when(key % 3 == 2, F.map_concat(status, tier)).alias("conditions"))
    return ac.scoped_review(asked, scoped_grants(t)).select("o_orderkey", "decision")


# --- audit -----------------------------------------------------------------------------------

AUDIT = """raw AS (SELECT alert_id AS event_id, epoch_us(ts) AS ts_us, src_user AS user_id, src_ip AS source_ip, full_log AS details, rule_desc AS action,
  CASE rule_desc WHEN 'error' THEN CASE WHEN rule_level > 9 THEN 'system_error' WHEN rule_level > 5 THEN 'authorization' ELSE 'authentication' END WHEN 'signup' THEN 'authentication'
    WHEN 'view' THEN CASE WHEN rule_level > 6 THEN 'pii_detection' ELSE 'data_access' END WHEN 'click' THEN 'api_access'
    ELSE CASE WHEN rule_level > 9 THEN 'security_violation' WHEN rule_level > 3 THEN 'configuration_change' ELSE 'user_action' END END AS kind,
  outcome AS raw_outcome, rule_level > 4 AS has_pii, 200 + rule_level * 30 AS status FROM alerts),
classed AS (SELECT *,
  CASE kind WHEN 'api_access' THEN CASE WHEN status < 400 THEN 'SUCCESS' ELSE 'FAILURE' END WHEN 'security_violation' THEN 'DETECTED' WHEN 'system_error' THEN 'FAILURE'
    WHEN 'authentication' THEN raw_outcome WHEN 'authorization' THEN raw_outcome ELSE 'SUCCESS' END AS outcome,
  CASE kind WHEN 'authentication' THEN CASE raw_outcome WHEN 'FAILURE' THEN 'high' ELSE 'medium' END WHEN 'authorization' THEN CASE raw_outcome WHEN 'FAILURE' THEN 'high' ELSE 'low' END
    WHEN 'data_access' THEN CASE WHEN has_pii THEN 'high' ELSE 'medium' END WHEN 'api_access' THEN CASE WHEN status >= 400 THEN 'high' ELSE 'low' END
    WHEN 'security_violation' THEN 'critical' WHEN 'configuration_change' THEN 'medium' WHEN 'pii_detection' THEN 'high' WHEN 'system_error' THEN 'high' ELSE 'low' END AS severity,
  CASE WHEN kind = 'pii_detection' THEN 'GDPR,HIPAA,PCI-DSS' WHEN kind = 'data_access' AND has_pii THEN 'GDPR,HIPAA' ELSE '' END AS tags FROM raw),
audit AS (SELECT *, CASE WHEN kind = 'security_violation' THEN 0.9e0 ELSE least(1e0,
  (CASE kind WHEN 'authentication' THEN 0.3e0 WHEN 'authorization' THEN 0.2e0 WHEN 'data_access' THEN 0.4e0 WHEN 'pii_detection' THEN 0.7e0 WHEN 'configuration_change' THEN 0.5e0
     WHEN 'system_error' THEN 0.3e0 ELSE 0.1e0 END * CASE outcome WHEN 'FAILURE' THEN 1.5e0 ELSE 1e0 END)
  * CASE severity WHEN 'low' THEN 1e0 WHEN 'medium' THEN 1.3e0 WHEN 'high' THEN 1.6e0 ELSE 2e0 END) END AS risk_score FROM classed)"""


def audit(t: Tables):
    level, desc = F.col("rule_level"), F.col("rule_desc")
    kind = (F.when(desc == "error", F.when(level > 9, "system_error").when(level > 5, "authorization").otherwise("authentication"))
            .when(desc == "signup", "authentication").when(desc == "view", F.when(level > 6, "pii_detection").otherwise("data_access"))
            .when(desc == "click", "api_access")
            .otherwise(F.when(level > 9, "security_violation").when(level > 3, "configuration_change").otherwise("user_action")))
    rows = t.alerts.select(
        F.col("alert_id").alias("event_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.col("src_user").alias("user_id"),
        F.col("src_ip").alias("source_ip"), F.col("full_log").alias("details"), desc.alias("action"), kind.alias("kind"), "outcome",
        (level > 4).alias("has_pii"), (200 + level * 30).alias("status"))
    fields = au.audit_fields(F.col("kind"), F.col("outcome"), F.col("has_pii"), F.col("status"))
    return au.with_risk(rows.select("event_id", "ts_us", "user_id", "source_ip", "details", "action", "kind", *fields))


@query("aud02_audit_severity", with_alerts(AUDIT + "SELECT event_id, kind, outcome, severity, tags FROM audit"))
def _(t: Tables):
    return audit(t).select("event_id", "kind", "outcome", "severity", F.array_join("compliance_tags", ",").alias("tags"))


@query("aud03_risk_score", with_alerts(AUDIT + "SELECT event_id, round(risk_score, 6) AS risk_score FROM audit"))
def _(t: Tables):
    return audit(t).select("event_id", r6("risk_score"))


@query("a33_audit_metrics", with_alerts(AUDIT + """SELECT coalesce(kind, 'all') AS kind, coalesce(severity, 'all') AS severity, count(*) AS events,
  count(*) FILTER (WHERE kind = 'authentication' AND outcome = 'FAILURE') AS failed_logins, count(*) FILTER (WHERE risk_score >= 0.7e0) AS high_risk, count(*) FILTER (WHERE tags <> '') AS tagged
FROM (SELECT * FROM audit) a GROUP BY GROUPING SETS ((kind), (severity), ())""".replace("count(*) FILTER (WHERE kind = 'authentication' AND", "count(*) FILTER (WHERE is_auth AND")
    .replace("(SELECT * FROM audit)", "(SELECT *, kind = 'authentication' AS is_auth FROM audit)")))
def _(t: Tables):
    return au.audit_metrics(audit(t))


@query("src10_audit_sinks", with_alerts(AUDIT + """SELECT 'audit' AS sink, event_id FROM audit UNION ALL SELECT 'compliance', event_id FROM audit WHERE tags <> ''
UNION ALL SELECT 'security', event_id FROM audit WHERE risk_score >= 0.7e0 OR severity = 'critical'"""))
def _(t: Tables):
    out = None
    for name, part in au.audit_sinks(audit(t)).items():
        rows = part.select(F.lit(name).alias("sink"), "event_id")
        out = rows if out is None else out.unionByName(rows)
    return out


LIMITS = {"failed_auth": (3600, 3), "pii_detection": (3600, 4), "high_risk": (3600, 5), "api_error": (1800, 3)}


@query("w04_rate_anomaly", with_alerts(AUDIT + ", k AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS kind, {s} AS seconds, {n} AS lim, ts_us, count(*) OVER (ORDER BY ts_us RANGE BETWEEN {s * 1_000_000} PRECEDING AND CURRENT ROW) AS n FROM audit WHERE {cond}"
    for (name, (s, n)), cond in zip(LIMITS.items(), ["kind = 'authentication' AND outcome = 'FAILURE'", "kind = 'pii_detection'", "risk_score >= 0.7e0",
                                                     "kind = 'api_access' AND outcome = 'FAILURE'"])) +
    ") SELECT DISTINCT kind, ts_us, n, seconds FROM k WHERE n >= lim"))
def _(t: Tables):
    return ac.rate_anomalies(au.rate_kinds(audit(t)), LIMITS).select("kind", "ts_us", "n", "seconds")
