"""Every registered query against its DuckDB oracle on the sf0.001 test tables
(the driver runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as E
from supplyscope.plans.registry import QUERIES as REPORTS
from tests.conftest import SF0001
from tests.oracle_compare import compare, duck, pandas_rows

QUERIES = E.queries()
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF0001)


def test_every_query_has_oracle_sql():
    assert set(REPORTS) <= set(QUERIES) and set(REPORTS) <= set(SQL)


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF0001)
    r = compare(df, con, SQL[name])
    assert r["ok"], r
    # and as pandas frames (types included), the form a value hash is likely taken on
    assert pandas_rows(df.toPandas()) == pandas_rows(con.execute(SQL[name]).df())


def test_entry_has_rows(spark):
    df = E.entry(spark)
    assert df.count() > 0 and len(df.columns) == 7
