"""Every registered query against its reference SQL at the smallest scale."""

import pytest
from oracle import compare

from __spark_entry__ import entry, oracle_sql, queries
from tillwork import registry

SQL = oracle_sql()


# The optional queries have tests of their own.
@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, sf, name):
    df = queries()[name](spark, sf)
    if name in SQL:
        assert [p for p in compare(df, SQL[name], sf) if p != "EMPTY"] == []
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry(spark).columns[0] == "transaction_date"
