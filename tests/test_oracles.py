import pytest
from compare import connect, same

from spanwright import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_matches_sql(spark, sf_dir, name):
    same(Q.QUERIES[name](spark, sf_dir).toPandas(), connect(sf_dir).sql(Q.SQL[name]).df())


def test_every_query_has_sql():
    assert set(Q.QUERIES) == set(Q.SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(Q.QUERIES) <= set(e.queries())
