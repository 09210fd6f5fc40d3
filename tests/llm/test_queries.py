"""The thin queries: those with SQL give the same rows, all of them run."""

import pytest
from tests.oracle import connection, rows

from factloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), connection(sf).sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0
