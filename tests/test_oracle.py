"""Every registered query against its SQL on the small tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from verify import compare, connect

QUERIES = queries()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    ok, text = compare(spark, con, QUERIES[name], oracle_sql().get(name), sf)
    assert ok or text.startswith("0 rows equal"), text


def test_entry(spark):
    df = entry(spark)
    assert df.columns[0] == "site"
    assert df.count() > 1
