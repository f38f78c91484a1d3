"""Entities that alerts declare, whatever their form, and addresses whose parts run past 255."""

from pyspark.sql import functions as F

from alertloom.functions import entities as ent
from alertloom.functions.addresses import carried
from alertloom.operators import lookup, patterns as pt
from alertloom.plans import retrieval as rt, rollup as ro


def alert_rows(spark, addresses):
    rows = [(i, f"h{i}", "1001", "view", 3, "host-1", f"user_{i}", a, f"file access for user_{i} from {a} on host-1") for i, a in enumerate(addresses)]
    names = "alert_id sha256 rule_id rule_desc rule_level agent_name src_user src_ip full_log".split()
    return spark.createDataFrame(rows, names).withColumn("ts", F.to_timestamp_ntz(F.lit("2024-01-03 10:00:00"))).withColumn("location", F.lit("host-1->/x"))


def test_declared_addresses_are_entities(spark):
    """F12 to F16, F23: the text pattern alone leaves out 10.0.263.9 and 10.0.5624.1."""
    addresses = ["10.0.1.2", "10.0.263.9", "10.0.5624.1"]
    rows = alert_rows(spark, addresses * 2).withColumn("src_user", F.lit("user_1"))
    active = pt.entity_activity(ro.host_day_rows(rows)).where("entity LIKE '10.%'").collect()
    assert {(r.entity, r.entity_type, r.events) for r in active} == {(a, "ip", 2) for a in addresses}


def test_rows_without_fields_still_have_text_entities(spark):
    rows = alert_rows(spark, ["10.0.1.2"]).drop("src_ip", "src_user")
    assert ro.host_day_rows(rows).first().entities == ["10.0.1.2", "user_0"]


def test_known_entities_of_a_question(spark):
    """the address of a question is known even where its text does not show one."""
    asked = spark.createDataFrame([("q", "activity of user_1 from 10.0.263.9")], "query_id string, query string")
    known = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(v).alias("value")) for k, v in (("IP", "10.0.263.9"), ("USER", "user_1"))])
    exact = rt.plan_strategies(asked.withColumn("known", known)).where("strategy = 'entity_exact'").orderBy("strategy_index").collect()
    assert [r.entity for r in exact] == ["10.0.263.9", "user_1"]


def test_carried_addresses_meet_their_networks(spark):
    """F22"""
    rows = spark.createDataFrame([("10.0.263.9",), ("10.0.7.9",), ("255.255.255.256",), ("a.b.c.d",), (None,)], "ip string")
    assert [r[0] for r in rows.select(carried(F.col("ip"))).collect()] == ["10.1.7.9", "10.0.7.9", None, None, None]
    nets = spark.createDataFrame([("10.1.7.0/24",)], "network string")
    found = lookup.longest_network(rows.select(carried(F.col("ip")).alias("ip")), nets).collect()
    assert [(r.ip, r.bits) for r in found] == [("10.1.7.9", 120)]


def test_half_the_mean_compares_alike(spark):
    """F16: 2.75 is not more than half of 5.5, in any order of the days."""
    days = [(f"2024-01-{8 + i:02d}", a) for i, a in enumerate([5.0, 6.0, 8.0, 3.0])]
    for order in (days, days[::-1], days[2:] + days[:2]):
        daily = spark.createDataFrame([(d, "u", "user", a, 1) for d, a in order], "day string, entity string, entity_type string, activity double, events bigint")
        row = ro.weekly_entities(daily.withColumn("day", F.to_date("day")).repartition(4)).first()
        assert (row.activity, row.variance) == (5.5, 3.25)
    daily = spark.createDataFrame([(f"2024-01-{8 + i:02d}", "u", "user", v, 1) for i, v in enumerate([4.0, 4.0, 6.0, 8.0])],
                                  "day string, entity string, entity_type string, activity double, events bigint")
    row = ro.weekly_entities(daily.withColumn("day", F.to_date("day"))).first()
    assert (row.activity, row.variance, row.flags) == (5.5, 2.75, "")


def test_logged_addresses_have_no_range(spark):
    """the SQL reads up to three digits a part."""
    from alertloom import config

    row = spark.createDataFrame([("x from 10.0.263.9 and 10.0.5624.1",)], "t string").select(ent.entities(F.col("t"), config.LOGGED_PATTERNS)).first()
    assert row[0] == ["10.0.263.9"]
