"""Every registered query runs; those with a SQL twin hold the same rows on DuckDB."""

import re

import compare
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
#: The corpus operators have tests of their own.
OWN = {k for k in QUERIES if not re.match(r"op\d+_|pipeline$", k)}


@pytest.fixture(scope="module")
def duck(sf):
    return compare.connection(sf)


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        assert compare.compare(df, duck, SQL[name]) is None
    else:
        assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
