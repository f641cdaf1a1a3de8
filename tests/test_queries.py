import oracle
import pytest

from tessaline.plans.oracle import SQL
from tessaline.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connection(FOLDER)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    assert oracle.differences(spark, con, FOLDER, QUERIES[name], SQL[name]) is None
