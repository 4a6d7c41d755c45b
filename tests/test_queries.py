import pytest

from fieldloom.plans import room_queries

NAMES = sorted(room_queries.ORACLE_SQL)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(same_as_sql, name):
    same_as_sql(room_queries.QUERIES[name], room_queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(room_queries.QUERIES) - set(NAMES)))
def test_without_sql(spark, small, name):
    assert room_queries.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
