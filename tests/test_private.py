"""Personal data, indicators and redaction on inline texts."""

import pytest
from pyspark.sql import functions as F

from alertloom import config
from alertloom.functions import pii, redaction
from alertloom.functions.matching import find_all
from alertloom.plans import redact as job


def hits(spark, text, **kw):
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return {(r.kind, r.value): r for r in job.pii_hits(frame, **kw).collect()}


def test_offsets_are_characters(spark):
    text = "é 12 – 345 🙂 6"
    row = spark.createDataFrame([(text,)], "t string").select(find_all(F.col("t"), r"\d+").alias("h")).first()
    assert [(h.value, text[h.start:h.start + h.len]) for h in row.h] == [("12", "12"), ("345", "345"), ("6", "6")]


@pytest.mark.parametrize("text,kind,value,confidence", [
    ("ssn 219-09-9999 on file", "ssn", "219-09-9999", 0.95),
    ("ssn 219 09 9999 on file", "ssn", "219 09 9999", 0.95),
    ("card 4539 5787 6362 1486 used", "credit_card", "4539 5787 6362 1486", 0.95),
    ("card 378282246310005 used", "credit_card", "378282246310005", 0.95),
    ("mail jane.roe@corp.org now", "email", "jane.roe@corp.org", 0.9),
    ("call 415-777-2671 now", "phone", "415-777-2671", 0.8),
    ("call +1 415 777 2671 now", "phone", "+1 415 777 2671", 0.8),
    ("by Jane Q. Roe today", "name", "Jane Q. Roe", 0.8),
    ("at 12 Long Hill Road today", "address", "12 Long Hill Road", 0.8),
    ("born 1980-02-29 there", "date_of_birth", "1980-02-29", 0.8),
    ("born March 3, 1980 there", "date_of_birth", "March 3, 1980", 0.8),
])
def test_detected_kinds(spark, text, kind, value, confidence):
    assert hits(spark, text)[(kind, value)].confidence == pytest.approx(confidence)


def test_scores_and_false_positives(spark):
    assert not hits(spark, "ssn 987-65-4321 on file")  # area above 899
    assert not hits(spark, "card 4539 5787 6362 1487 used")  # fails the check digit
    assert not hits(spark, "mail joe@example.com now")
    assert not hits(spark, "sample 219-09-9999")
    assert hits(spark, "the login of jane.roe@corp.org")[("email", "jane.roe@corp.org")].confidence == pytest.approx(0.81)
    assert hits(spark, "private: jane.roe@corp.org")[("email", "jane.roe@corp.org")].confidence == pytest.approx(0.99)


def test_custom_pattern(spark):
    assert ("custom", "EMP-77") in hits(spark, "badge EMP-77 seen", custom=[("badge", r"EMP-\d+", 0.8)])
    assert not hits(spark, "badge EMP-77 seen", custom=[("badge", r"EMP-\d+", 0.5)])


def indicators(spark, text):
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return {(r.kind, r.value): r for r in job.indicator_hits(frame).collect()}


def test_indicators(spark):
    found = indicators(spark, "alert CVE-2021-44228 from 10.1.2.3:8080 to 8.8.8.8 by cmd.exe over SSH rule 5710 EventID 4625")
    kinds = {k for k, _ in found}
    assert {"cve", "ip_address", "port", "process_name", "protocol", "signature_id", "event_id"} <= kinds
    assert found[("cve", "CVE-2021-44228")].confidence == pytest.approx(1.0)
    assert found[("ip_address", "10.1.2.3")].confidence == pytest.approx(0.935)
    assert not indicators(spark, "host 999.1.1.1")
    assert not indicators(spark, "phone list 10.1.2.3")


@pytest.mark.parametrize("ip,scope", [("10.0.0.1", "private"), ("172.31.0.1", "private"), ("172.32.0.1", "public"), ("127.0.0.1", "system"),
                                      ("169.254.9.9", "system"), ("8.8.8.8", "public"), ("256.1.1.1", "invalid"), ("01.2.3.4", "invalid")])
def test_ip_scope(spark, ip, scope):
    assert spark.range(1).select(pii.ip_scope(F.lit(ip))).first()[0] == scope


@pytest.mark.parametrize("value,masked", [("219-09-9999", "***-**-****"), ("4539578763621486", "4539-****-****-1486"), ("415-777-2671", "***-***-****"),
                                          ("(415) 777-2671", "(***) ***-****"), ("jane@corp.org", "j**e@corp.org"), ("jo@corp.org", "**@corp.org"),
                                          ("ab", "**"), ("abcd", "a**d"), ("abcdef", "ab**ef")])
def test_masks(spark, value, masked):
    assert spark.range(1).select(redaction.mask(F.lit(value))).first()[0] == masked


def redacted(spark, text, mode="embedding", **kw):
    return job.redact(spark.createDataFrame([(1, text)], "doc_id long, text string"), mode=mode, **kw).first()


def test_redaction_keeps_indicators_and_hides_people(spark):
    text = "attack by Jane Roe (219-09-9999) from 8.8.8.8 and 10.0.0.5, hash d41d8cd98f00b204e9800998ecf8427e"
    row = redacted(spark, text)
    assert "Jane Roe" not in row.redacted and "219-09-9999" not in row.redacted and "10.0.0.5" not in row.redacted
    assert "8.8.8.8" in row.redacted and "d41d8cd98f00b204e9800998ecf8427e" in row.redacted and "PRIVATE_IP_" in row.redacted
    assert row.redactions == 2 and row.indicators == 3


def test_redaction_is_idempotent_and_clean_text_is_untouched(spark):
    once = redacted(spark, "signed by Jane Roe, born 1980-02-28, card 4539 5787 6362 1486").redacted
    again = redacted(spark, once)
    assert again.redacted == once and again.redactions == 0
    assert redacted(spark, "nothing to hide").redacted == "nothing to hide"


def test_overlapping_hits_take_the_longer(spark):
    # the address covers the name inside it
    row = redacted(spark, "at 12 Jane Roe Street now")
    assert row.redactions == 1 and row.redacted.startswith("at ADDRESS_TOKEN_") and row.redacted.endswith(" now")


def test_rule_override_and_modes(spark):
    assert "[REDACTED]" in redacted(spark, "by Jane Roe", rules={"name": ("remove", False, 0.6)}).redacted
    assert "10.0.0.5" in redacted(spark, "from 10.0.0.5", mode="export").redacted
    # 0.7 is out of reach for a failed check digit in any mode
    assert redacted(spark, "card 4539 5787 6362 1487", mode="display").redactions == 0


def test_export_redacts_every_text_column(spark):
    rows = spark.createDataFrame([(1, "by Jane Roe", "ok")], "id long, a string, b string")
    out = job.export_redacted(rows).first()
    assert out.id == 1 and "Jane" not in out.a and out.b == "ok"


def test_weights_cover_every_kind():
    assert {k for k, _ in config.PII_PATTERNS} <= set(config.PII_WEIGHTS)


@pytest.mark.parametrize("gates,patterns", [(pii.PII_GATES, config.PII_PATTERNS), (pii.INDICATOR_GATES, config.INDICATOR_PATTERNS)])
def test_gates_lose_no_hit(spark, gates, patterns):
    texts = ["123-45-6780", "123 45 6780", "123456780", "4539578763621486", "3782 822463 10005", "a@b.org", "(415) 777-2671", "415.777.2671", "+1 415 777 2671",
             "Jane Roe", "Jane Q. Roe", "12 Hill Road", "1/2/1980", "1980-02-28", "May 3, 1980", "8.8.8.8", "fe:ab:cd:ef:fe:ab:cd:ef", "a.org", "deadbeef" * 4,
             "port 80", "PORT=80", "x:80", *"http HTTPS ftp Ftps ssh TELNET smb pop3 imap dns dhcp snmp tcp udp icmp".split(), "a.EXE", "a.dLL", "/usr/bin/a",
             "/sbin/b", "cve-2021-44228", "sid 7", "RULE: 7", "event id 7", "EventID=7"]
    frame = spark.createDataFrame([(t,) for t in texts] + [("x " + t + " y",) for t in texts], "t string")
    located = lambda k, p: pii._scored(pii.located(F.col("t"), p, 5), k, lambda v, low: F.lit(1.0))
    plain = F.concat(*[F.when(F.col("t").rlike(p), F.array(F.lit(k))).otherwise(F.array().cast("array<string>")) for k, p in patterns])
    rows = frame.select("t", F.array_distinct(plain).alias("all"), F.transform(pii.gated(F.col("t"), gates, patterns, located), lambda h: h["kind"]).alias("gated")).collect()
    assert {k for r in rows for k in r["all"]} == {k for k, _ in patterns}
    for r in rows:
        assert set(r["all"]) == set(r["gated"]), r.t


def test_kinds_that_need_a_digit_share_one_test():
    assert not {"ssn", "credit_card", "phone", "address", "date_of_birth", "port", "cve", "signature_id", "event_id"} & set(pii.WITHOUT_DIGIT)


@pytest.mark.parametrize("name", ["j08_threat_intel", "red01_redact_threats"])
def test_threat_query_searches_the_texts_once(spark, monkeypatch, name):
    from alertloom.catalog import load_all

    searches, search = [], job.indicator_hits
    monkeypatch.setattr(job, "indicator_hits", lambda *a, **b: searches.append(1) or search(*a, **b))
    load_all()[0][name](spark, "/root/testdata/sf0.001")
    assert len(searches) == 1
