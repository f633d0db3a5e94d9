import pytest

from fotoloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, small, same_as_sql, name):
    query, sql = registry.queries()[name], registry.oracle_sql().get(name)
    if sql:
        same_as_sql(spark, name, query, sql, small)
    else:
        assert query(spark, small).count() > 0


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
