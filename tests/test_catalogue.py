"""The summary catalogue: what a query does not show is not computed, and the rest once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from alertloom.plans import rollup as ro
from parity import compare, connect

KIND = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Two hosts over a change of month, and events without a time or a user; the second of February has no user at all."""
    rows = [(i, dt.datetime(2024, 1, 22, 8, i % 60) + dt.timedelta(days=i % 15), i % 2, ("view", "error", "click")[i % 3], 40.0 + i, "{}")
            for i in range(300) if i % 15 != 11]
    rows += [(1000, None, 1, "view", 1.0, "{}"), (1001, dt.datetime(2024, 1, 23, 9), None, "error", 2.0, "{}"),
             (1002, dt.datetime(2024, 2, 2, 9), None, "error", 3.0, "{}")]
    folder = tmp_path_factory.mktemp("catalogue")
    spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(str(folder / "events.parquet"))
    single = next((folder / "events.parquet").glob("part-*"))
    other = tmp_path_factory.mktemp("single")
    (other / "events.parquet").write_bytes(single.read_bytes())
    return str(other)


def same(spark, folder, name):
    return compare(spark, connect(folder), folder, name, entry.queries()[name], entry.oracle_sql()[name])


@pytest.mark.parametrize("name", ["j09_lineage", "j07_summaries_in_period", "t06_summary_order"])
def test_lineage_and_order_search_no_text(spark, events, monkeypatch, name):
    monkeypatch.setattr(ro, "alert_entities", lambda *_: F.raise_error(F.lit("a text was searched")).cast("array<string>"))
    assert same(spark, events, name) is None


def test_the_catalogue_searches_each_text_once(spark, events, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(text, declared):
        def found(*values):
            seen.add(1)
            return [v for v in values if v]
        return F.udf(found, "array<string>")(*[F.col(c) for c in declared])

    monkeypatch.setattr(ro, "alert_entities", counted)
    shown = entry.queries()["a32_storage_stats"](spark, events)
    assert shown.count() and 0 < seen.value <= spark.read.parquet(f"{events}/events.parquet").count()
