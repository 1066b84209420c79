import pytest

from millrace.llm import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, data, name):
    compare(spark, data, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0
