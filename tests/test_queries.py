import pytest
from twins import assert_twin

from factorweave.operators import queries as operators
from factorweave.plans import analytics

SQL = operators.ORACLE_SQL | analytics.ORACLE_SQL
ALL = operators.QUERIES | analytics.QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, name):
    assert_twin(spark, sf, ALL[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_gives_rows(spark, sf, name):
    assert ALL[name](spark, sf).count() > 0
