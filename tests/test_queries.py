"""Every registered query against its SQL, on whole tables."""

import oracle
import pytest

from mnemolake.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        assert oracle.compare(df, con, SQL[name]) == ""
    else:
        assert df.count() > 0  # held against brute force in test_operators.py
