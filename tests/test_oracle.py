"""Every registered query against its SQL on the smallest driver tables."""

import pytest
from compare import compare, duck

from corpuskit import plans

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, info = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert ok, info
