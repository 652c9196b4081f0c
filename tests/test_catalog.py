import pytest

from lodestone.plans import catalog


def test_every_query_has_sql():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_matches_sql(spark, data, duck, same_rows, name):
    same_rows(catalog.QUERIES[name](spark, data).toPandas(), duck.execute(catalog.ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert len(rows) == 10
    assert set(e.oracle_sql()) <= set(e.queries())
