"""Every registered query against its DuckDB oracle (sf0.001 here; sf0.01 via
scripts/check_oracle.py).  Queries without SQL get a rows/schema smoke check."""

import pytest

import __spark_entry__ as se
from gymlake.plans import catalog
from compare import compare, duck_connect

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name not in SQL:
        assert df.count() >= 0
        return
    ok, info = compare(df, con, SQL[name])
    assert ok, info


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert df.count() > 0
    assert "completion_rate" in df.columns


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) and set(QUERIES) <= set(se.queries())
