import pytest

from granary.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_as_sql(name, same):
    same(queries.queries()[name], SQL[name])
