"""Networks, domains, threat tables, narrow permissions and rates against plain versions."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from alertloom.functions import addresses, pii
from alertloom.operators import access as ac
from alertloom.operators import joins, lookup
from alertloom.plans import redact as job

SPECIAL = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "0.0.0.0/8", "192.0.0.0/24", "192.0.2.0/24",
           "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "::1/128", "::/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64",
           "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "fc00::/7", "fe80::/10", "2001:3::/32", "2001:20::/28", "2001:30::/28", "2001:4:112::/48"]


def bits_of(text):
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        return None
    return f"{int(ip) | (0xFFFF << 32 if ip.version == 4 else 0):0128b}"


def full_form(number):
    digits = f"{number:032x}"
    return ":".join(digits[i:i + 4] for i in range(0, 32, 4))


def edges_of_ranges():
    out = []
    for text in SPECIAL:
        net = ipaddress.ip_network(text)
        top = 2 ** (32 if net.version == 4 else 128) - 1
        low, high = int(net.network_address), int(net.broadcast_address)
        make = ipaddress.IPv4Address if net.version == 4 else full_form
        out += [str(make(n)) for n in {low - 1, low, high, high + 1} if 0 <= n <= top]
    return out


def test_bits_equal_those_of_the_standard_library(spark):
    rng = random.Random(2)
    texts = edges_of_ranges() + [str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128) & rng.getrandbits(128))) for _ in range(60)]
    texts += [ipaddress.IPv6Address(rng.getrandbits(128)).exploded.upper() for _ in range(20)]
    texts += ["", "1.2.3", "01.2.3.4", "256.1.1.1", "1.2.3.4.5", "::", "1::", "::1", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", ":1:2:3:4:5:6:7",
              "12345::", "g::1", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8::"]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "ip string").select("ip", addresses.address_bits(F.col("ip")).alias("b")).collect()
    assert {r.ip: r.b for r in rows} == {t: bits_of(t) for t in texts} | {None: None}


def test_scopes_follow_the_ranges(spark):
    tokens = [ipaddress.ip_network(n) for n in SPECIAL[:5]]

    def scope(text):
        ip = ipaddress.ip_address(text)
        if ip.version == 6:
            inside = any(ip in ipaddress.ip_network(n) for n in SPECIAL[12:23])
            spared = any(ip in ipaddress.ip_network(n) for n in SPECIAL[23:])
            return "ipv6_system" if ip.is_loopback or ip.is_link_local else "ipv6_reserved" if inside and not spared else "ipv6"
        if any(ip in n for n in tokens):
            return "system" if ip.is_loopback or ip.is_link_local else "private"
        return "reserved" if any(ip in ipaddress.ip_network(n) for n in SPECIAL[5:12]) else "public"

    texts = edges_of_ranges()
    rows = spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", pii.ip_scope(F.col("ip")).alias("s"), pii.ip_version(F.col("ip")).alias("v")).collect()
    assert {r.ip: (r.s, r.v) for r in rows} == {t: (scope(t), ipaddress.ip_address(t).version) for t in texts}
    odd = spark.range(1).select(*[pii.ip_scope(F.lit(t)).alias(t) for t in ("192.0.0.9", "1:2", "1.2")]).first()
    assert tuple(odd) == ("public", "invalid", "invalid")


def test_longest_network_equals_brute_force(spark):
    rng = random.Random(4)
    ips = [f"10.{rng.randrange(3)}.{rng.randrange(4)}.{rng.randrange(256)}" for _ in range(200)] + [f"2001:db8::{rng.randrange(40):x}" for _ in range(30)]
    nets = [f"10.{rng.randrange(3)}.{rng.randrange(4)}.{rng.randrange(256)}/{rng.choice([8, 15, 24, 27, 32])}" for _ in range(25)]
    nets += ["2001:db8::10/124", "2001:db8::/122", "10.0.0.0/33", "x/8", "10.0.0.0/", "2001:db8::3"]
    got = {r.ip: r.bits for r in lookup.longest_network(
        spark.createDataFrame([(i,) for i in ips] * 2 + [(None,), ("no",)], "ip string"),
        spark.createDataFrame([(n,) for n in nets] + [(None,)], "network string")).collect()}
    want = {}
    for ip in ips:
        for net in nets:
            try:
                net = ipaddress.ip_network(net, strict=False)
            except ValueError:
                continue
            if ipaddress.ip_address(ip) in net:
                want[ip] = max(want.get(ip, 0), net.prefixlen + (96 if net.version == 4 else 0))
    assert got == want


def test_longest_domain(spark):
    names = spark.createDataFrame([("Evil.com",), ("a.evil.com",), ("com.org",), ("",), (None,)], "name string")
    asked = spark.createDataFrame([("x.a.EVIL.com",), ("evil.com",), ("notevil.com",), ("com",), ("",), (None,), ("b.com.org",)], "domain string")
    got = {r.domain: r.name for r in lookup.longest_domain(asked, names).collect()}
    assert got == {"x.a.EVIL.com": "a.evil.com", "evil.com": "evil.com", "b.com.org": "com.org"}
    assert lookup.longest_domain(asked.limit(0), names).count() == 0 and lookup.longest_domain(asked, names.limit(0)).count() == 0


INTEL = [("ip_address", "10.0.0.5"), ("ip_address", "172.16.0.0/12"), ("ip_address", "fe80::/10"), ("domain", "bad.io"), ("file_hash", "D41D8CD98F00B204E9800998ECF8427E")]


def test_listed_indicators_are_flagged_and_raised(spark):
    hits = spark.createDataFrame([(1, "ip_address", "10.0.0.5", 0.8), (2, "ip_address", "10.0.0.6", 0.8), (3, "ip_address", "172.20.1.1", 0.9),
                                  (4, "domain", "BAD.io", 0.5), (5, "file_hash", "d41d8cd98f00b204e9800998ecf8427e", 0.95), (6, "domain", "10.0.0.5", 0.5),
                                  (7, "ip_address", "fe80:0:0:0:0:0:0:1", 0.5), (8, "ip_address", None, 0.5)], "i int, kind string, value string, confidence double")
    got = {r.i: (r.is_threat, round(r.confidence, 6)) for r in joins.threat_intel(hits, spark.createDataFrame(INTEL, "kind string, value string")).collect()}
    assert got == {1: (True, 0.96), 2: (False, 0.8), 3: (True, 1.0), 4: (True, 0.65), 5: (True, 1.0), 6: (False, 0.5), 7: (True, 0.6), 8: (False, 0.5)}


def test_listed_private_addresses_stay_readable(spark):
    rows = [(1, "from 10.0.0.5 to 10.0.0.6 by cmd.exe"), (2, "from 10.0.0.6 to 172.16.9.9"), (3, None), (4, ""), (None, "seen 10.0.0.5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.redacted for r in job.redact(docs, intel=spark.createDataFrame(INTEL, "kind string, value string")).collect()}
    assert "10.0.0.5" in out[1] and "10.0.0.6" not in out[1] and "172.16.9.9" in out[2] and "10.0.0.6" not in out[2]
    assert out[3] is None and out[4] == "" and "10.0.0.5" in out[None]
    none = spark.createDataFrame([], "kind string, value string")
    assert {r.doc_id: r.redacted for r in job.redact(docs, intel=none).collect()} == {r.doc_id: r.redacted for r in job.redact(docs).collect()}


def test_scoped_review_equals_brute_force(spark):
    rng = random.Random(6)
    maybe = lambda *values: rng.choice([None, *values])
    conditions = lambda: maybe({}, {"a": "1"}, {"a": "1", "b": "2"}, {"a": "2"}, {"b": "2"})
    grants = [(rng.choice("uv"), rng.choice("rs"), rng.choice(["read", "write", "admin"]), maybe("1", "2"), conditions()) for _ in range(14)]
    asked = [(i, maybe("u", "v", "w"), maybe("r", "s"), maybe("read", "write", "delete"), maybe("", "1", "2"), conditions(), "x") for i in range(400)]

    def allow(row):
        _, user, resource, action, rid, cond, _ = row
        return any(g[0] == user and g[1] == resource and (g[2] == "admin" or g[2] == action or (g[2], action) == ("write", "read"))
                   and (not rid or g[3] == rid) and (not cond or not g[4] or all(g[4].get(k) == v for k, v in cond.items())) for g in grants)

    shape = "user_id string, resource string, action string, resource_id string, conditions map<string,string>"
    out = ac.scoped_review(spark.createDataFrame(asked, f"id int, {shape}, allowed string"), spark.createDataFrame(grants, shape)).collect()
    assert {r.id: r.decision == "allow" for r in out} == {r[0]: allow(r) for r in asked}
    assert len(out) == len(asked) and all(r.allowed == "x" for r in out)
    empty = ac.scoped_review(spark.createDataFrame(asked[:5], f"id int, {shape}, allowed string"), spark.createDataFrame([], shape))
    assert {r.decision for r in empty.collect()} == {"deny"}


def test_narrow_grants_are_inherited(spark):
    perms = spark.createDataFrame([("top", "r", "read", "1", {"b": "2", "a": "1"}), ("low", "r", "write", None, None)],
                                  "role string, resource string, action string, resource_id string, conditions map<string,string>")
    people = spark.createDataFrame([("u", "low", None), ("u", "low", None), ("v", "top", 1)], "user_id string, role string, expires_at int")
    parents = spark.createDataFrame([("top", "low")], "parent string, child string")
    got = ac.effective_permissions(people, parents, perms, F.lit(2)).collect()
    assert sorted((r.user_id, r.action, r.resource_id, r.conditions and [tuple(e) for e in r.conditions]) for r in got) == [
        ("u", "read", "1", [("a", "1"), ("b", "2")]), ("u", "write", None, None)]


def test_request_statistics_use_the_rate_limit(spark):
    flagged = spark.createDataFrame([(1, "a", "ok"), (2, "a", "path_traversal_attempt"), (3, "b", "ok"), (4, "b", "suspicious_user_agent")],
                                    "request_id int, ip string, verdict string")
    rated = spark.createDataFrame([(1, "pass"), (2, "limited"), (3, "blocked"), (4, "pass")], "request_id int, verdict string")
    row = ac.request_stats(ac.with_rates(flagged, rated)).first()
    assert (row.total, row.blocked, row.limited, row.suspicious, row.active_ips) == (4, 2, 1, 1, 2)


@pytest.mark.parametrize("text,cut", [("10.0.0.0/8", 104), ("::/0", 0), ("1.2.3.4", 128), ("1.2.3.4/33", None), ("1.2.3.4/", None), ("::1/129", None), ("x/1", None)])
def test_network_prefix(spark, text, cut):
    got = spark.range(1).select(addresses.network_prefix(F.lit(text))).first()[0]
    assert (None if got is None else len(got)) == cut
