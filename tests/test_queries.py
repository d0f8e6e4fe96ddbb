import pytest

from granary import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_as_sql(name, same):
    same(queries.queries()[name], SQL[name])


def test_entry_holds_all():
    import __spark_entry__ as e

    assert set(queries.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
