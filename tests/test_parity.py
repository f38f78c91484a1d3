"""Registered queries against their SQL twins.

A sample of every catalogue module by default; ALERTLOOM_ALL=1 runs all.
"""

import os

import pytest

import parity
import __spark_entry__ as entry

SF_DIR = os.environ.get("ALERTLOOM_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = (
    "src01 src05 src06 src07 src12 f01 f06 f09 f15 f16 f18 j02 j04 j06 j08_networks j09 j10_access j10_scoped j11 j12 a01 a04 a11 a16 a20 a21 a26 a30 a31 a33 a41 "
    "w04 w05 w06 w07 t04 u02 u04 v01 v06 v08 v09 v11 v14 v18 c02 c03 c05 c07 p01 p06 red01 red03 red06_modes_export aud01 i01 i04 st02 st03 st05 st07 st09"
).split()
NAMES = [n for n in entry.oracle_sql() if os.environ.get("ALERTLOOM_ALL") or n.startswith(tuple(SAMPLE))]


@pytest.fixture(scope="module")
def con():
    return parity.connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    problem = parity.compare(spark, con, SF_DIR, name, entry.queries()[name], entry.oracle_sql()[name])
    assert problem in (None, "EMPTY"), problem


def test_entry_has_rows(spark):
    frame = entry.entry(spark)
    assert frame.limit(1).count() == 1 and "mean_risk" in frame.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
