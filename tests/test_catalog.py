import pytest

from helixspark import catalog


def test_every_query_has_sql():
    assert catalog.QUERIES.keys() == catalog.ORACLE_SQL.keys()


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, sf, same_rows, name):
    same_rows(catalog.QUERIES[name](spark, sf), catalog.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "n"]
    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
