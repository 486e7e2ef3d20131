"""Every core query with SQL equals DuckDB on whole tables; the others run and have stable columns."""

import os

import oracle
import pytest

from sonmai.plans import catalogue

D = f"{oracle.DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(D)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_equals_sql(spark, con, name):
    assert oracle.difference(spark, con, D, catalogue.QUERIES[name], catalogue.ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, name):
    a = catalogue.QUERIES[name](spark, D)
    assert a.count() > 0 and len(set(a.columns)) == len(a.columns)
