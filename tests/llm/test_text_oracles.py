"""The text queries that SQL can state against DuckDB."""

import pytest

from quaylight.llm.queries import ORACLES, QUERIES
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    same(QUERIES[name](spark, SF), ORACLES[name], SF)
