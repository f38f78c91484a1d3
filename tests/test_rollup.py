"""Rollups read uncut tables; storage and access rules of the same round."""

import datetime as dt
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from alertloom.functions.entities import entities
from alertloom.operators import access, issues, patterns as pt
from alertloom.plans import rollup as ro
from alertloom.session import scratch_dir
from alertloom.sources import stores


@pytest.fixture(scope="module")
def level(spark):
    """One host and day with 14 active users and 8 rules; the last ones weigh most in total over two hosts."""
    rows, n = [], 0
    for host in ("h1", "h2"):
        for user in range(14):
            for k in range(3):
                n += 1
                rows.append((n, dt.datetime(2024, 1, 3, 4, n % 60), f"{n % 8}", f"rule{n % 8}", 5, host, f"{host}->/x", f"login for user_{user:02d} from 10.0.0.{user} on {host}"))
    alerts = spark.createDataFrame(rows, "alert_id long, ts timestamp, rule_id string, rule_desc string, rule_level int, agent_name string, location string, full_log string")
    keyed = alerts.select(F.concat(F.lit("c/"), "agent_name").alias("cluster_id"), F.to_date("ts").alias("day"), "alert_id", F.md5(F.col("alert_id").cast("string")).alias("sha256"),
                          "ts", "rule_id", "rule_desc", "rule_level", "agent_name", "location", "full_log", entities(F.col("full_log")).alias("entities"))
    return ro.cluster_level(keyed)


def test_the_eleventh_entity_counts(level):
    users = {r["entity"]: r["events"] for r in level.activity.where("cluster_id = 'c/h1'").collect()}
    assert {f"user_{u:02d}" for u in range(14)} <= set(users) and set(users.values()) == {3}
    daily = {r["entity"]: r["events"] for r in ro.daily_entities(level).collect()}
    assert len(daily) == 28 and daily["user_13"] == 6
    assert ro.daily_metrics(level).first()["entities"] == 28
    assert level.activity.count() == 56 and pt.entity_activity(level.rows, top=10).count() == 20


def test_the_sixth_pattern_counts(level):
    assert level.patterns.where("pattern_type = 'rule_pattern'").groupBy("cluster_id").count().collect()[0]["count"] == 8
    assert ro.daily_metrics(level).first()["patterns"] == level.patterns.count() >= 16
    assert pt.rule_patterns(level.rows, level.base, top=5).count() == 10
    first = level.summaries.where("cluster_id = 'c/h1'").first()["summary_text"]
    assert "Primary pattern: Multiple occurrences of" in first


def test_issues_are_kept_beyond_any_number(spark):
    kind = "issue_id string, ts timestamp, severity string, title string, summary string, category string"
    many = spark.range(1500).select(F.concat(F.lit("i"), "id").alias("issue_id"), F.timestamp_seconds("id").alias("ts"), *[F.lit("x").alias(c) for c in ("severity", "title", "summary", "category")])
    none = spark.createDataFrame([], kind)
    assert issues.merge_issues(many, none).count() == 1500 and issues.merge_issues(many, none, cap=10).count() == 10


def test_white_list_keeps_requests_without_an_address(spark):
    asked = spark.createDataFrame([(1, "a", 10), (2, None, 20), (3, "b", 30)], "request_id long, ip string, ts_us long")
    got = {r["request_id"]: r["accepted"] for r in access.rate_limit(asked, whitelist=["a"]).collect()}
    assert got == {1: True, 2: True, 3: True}


def test_admin_covers_every_action(spark):
    granted = spark.createDataFrame([("u", "r", "admin"), ("v", "r", "write")], "user_id string, resource string, action string")
    asked = spark.createDataFrame([("u", "r", "create"), ("u", "s", "read"), ("v", "r", "read"), ("v", "r", "create"), ("w", "r", "read")], "user_id string, resource string, action string")
    got = {(r[0], r[1], r[2]): r["decision"] for r in access.access_review(asked, granted).select("user_id", "resource", "action", "decision").collect()}
    assert got == {("u", "r", "create"): "allow", ("u", "s", "read"): "deny", ("v", "r", "read"): "allow", ("v", "r", "create"): "deny", ("w", "r", "read"): "deny"}


def test_only_a_missing_path_is_an_empty_store(spark, tmp_path):
    like = spark.range(3)
    assert stores.read_or_empty(spark, str(tmp_path / "none"), like).count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        stores.read_or_empty(spark, str(tmp_path / "bad"), like).count()


def test_scratch_folders_need_a_shared_root_off_local_mode(spark):
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        conf = Conf({"spark.master": "yarn"})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(Session, "x")
    Session.conf["spark.checkpoint.dir"] = "hdfs://shared"
    assert scratch_dir(Session, "x").startswith("hdfs://shared/x-")


def test_python_stages_run_from_another_folder(tmp_path):
    """With the package on PYTHONPATH, as --py-files puts it on a cluster."""
    root = str(Path(__file__).resolve().parents[1])
    code = ("from alertloom.session import build_session\nfrom alertloom.operators.search import vector_search\n"
            "s = build_session('x', 'local[1]', {'spark.ui.enabled': 'false'})\n"
            "c = s.createDataFrame([(1, [1.0, 0.0])], 'id long, embedding array<double>')\n"
            "q = s.createDataFrame([(7, [1.0, 0.0])], 'query_id long, embedding array<double>')\n"
            "print('FOUND', vector_search(c, q, 1).first()['id'])\n")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=180, env=os.environ | {"PYTHONPATH": root})
    assert "FOUND 1" in done.stdout, done.stderr[-800:]
