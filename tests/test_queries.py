"""Every query against its SQL on the smallest tables, or that it runs where SQL can't tell its result."""

import pytest
from compare import duck, rows

from quarry.plans import registry


@pytest.fixture(scope="module")
def con(data):
    return duck(data)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, data, con, name):
    got = registry.QUERIES[name](spark, data).toPandas()
    want = con.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() >= 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
