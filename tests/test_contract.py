"""Driver contract without Spark: every oracle belongs to a registered query, binds in DuckDB
against the driver's views and has unique column names (values are compared by test_oracle and
tools/oracle_check.py)."""

import pytest

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def duck():
    from tools.oracle_check import duck_connect

    return duck_connect(SF_SMALL)


def test_every_oracle_binds(duck):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    for name, sql in o.items():
        cols = duck.sql(sql).columns  # binds (name resolution, types) without running
        assert len(cols) == len(set(cols)), (name, cols)


def test_names_are_operator_names():
    import __spark_entry__ as e

    for name in e.queries():
        assert name.isidentifier() and name == name.lower()
