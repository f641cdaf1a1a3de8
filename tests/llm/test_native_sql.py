import oracle
import pytest

from tessaline.llm.oracle import SQL
from tessaline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    assert oracle.differences(spark, oracle.connection(FOLDER), FOLDER, QUERIES[name], SQL[name]) is None
