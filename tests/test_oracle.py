"""Every query with SQL gives the values DuckDB gives; the others give rows."""

import pytest

from clickloom.plans.catalog import ORACLES, QUERIES
from tests.compare import check, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert check(spark, con, SF, name, QUERIES, ORACLES) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
