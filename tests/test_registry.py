"""Registered queries against DuckDB on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry_module
from check import connect, rows_of

SF = "/root/testdata/sf0.001"
# the long-running streams and the raw-record jobs are covered by their own tests and by check.py
SAMPLE = [n for n in entry_module.oracle_sql() if not n.startswith(("stream_", "norm_", "incident_absorption", "incident_matches"))]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_every_sql_has_its_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert len(entry_module.queries()) > 200


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["user", "match_count", "first_us", "last_us"] and df.count() == 8


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_second_engine(spark, name):
    df = entry_module.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = connect(SF).sql(entry_module.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == rows_of(rel.columns, rel.fetchall())
