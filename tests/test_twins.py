"""Every registered query against its SQL twin."""

import pytest
from check import compare, connect
from conftest import TESTDATA

from panelwright.plans.catalog import QUERIES, SQL

pytestmark = pytest.mark.skipif(not TESTDATA.exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(str(TESTDATA))


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, con, name):
    # On ten suppliers a result can rightly be empty; check.py wants rows from the larger tables.
    ok, note = compare(spark, con, str(TESTDATA), QUERIES[name], SQL.get(name), may_be_empty=True)
    assert ok, note


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["state", "yr", "chg", "chg_p"]
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
