"""Every registered query against its SQL in DuckDB."""

import pytest

import __spark_entry__ as entry_points
from compare import check, duck
from tongueloom.plans import catalog

SF = "/root/testdata/sf0.001"
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    verdict = check(spark, con, SF, name, entry_points.queries()[name], SQL.get(name))
    assert verdict.startswith("ok" if name in SQL else "rows only"), verdict


def test_no_query_lacks_sql():
    assert set(catalog.QUERIES) <= set(SQL)


def test_flagship(spark):
    rows = entry_points.entry(spark).collect()
    assert len(rows) == 4 and abs(sum(r["p"] for r in rows) - 1) < 1e-5
