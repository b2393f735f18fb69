"""Every query with an oracle text equals DuckDB on the smallest tables."""

import pytest
from check import compare, connect

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, sf, con, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = con.execute(ORACLE[name]).fetchdf()
    assert compare(got, want).startswith("ok"), compare(got, want)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert {"stream", "block", "win", "divergence", "z", "alarm"} <= set(df.columns)
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
