"""Operator queries against their SQL in DuckDB."""

import pytest

from siltstone.llm import queries
from tests.compare import same_rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    same_rows(queries.queries()[name](spark, sf), queries.oracle_sql()[name], sf)


def test_ten_operators():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 11))
