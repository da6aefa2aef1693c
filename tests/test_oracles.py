"""Every registered query of the library's own operators against its SQL."""

import pytest

from gridspark.plans import QUERIES, SQL

from .conftest import DATA, same_rows


def test_each_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    same_rows(QUERIES[name](spark, DATA), duck.sql(SQL[name]))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(SQL) <= set(entry.oracle_sql())
