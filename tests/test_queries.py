"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_a_known_oracle():
    without = set(entry.queries()) - set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(name == "pipeline" or name.startswith("op") for name in without)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        rows = df.count()
        assert rows > 0 and len(set(df.columns)) == len(df.columns)
    else:
        assert differences(df, con, sql) == []
