import pytest

import __spark_entry__ as entry
from quire import catalog
from tests.compare import duck_rows, rows_of


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, tiny, name):
    assert rows_of(catalog.QUERIES[name](spark, tiny)) == duck_rows(catalog.ORACLE[name], tiny)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_runs(spark, tiny, name):
    assert catalog.QUERIES[name](spark, tiny).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
