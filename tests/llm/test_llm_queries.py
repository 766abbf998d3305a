import pytest
from twins import assert_twin

from factorweave.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, sf, name):
    assert_twin(spark, sf, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES if q.startswith("op")) == list(range(1, 14))
