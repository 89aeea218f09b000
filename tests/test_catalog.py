"""Each registered query that has SQL gives the rows of the SQL on the smallest tables."""

import duckdb
import pytest

from tidemark.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for name in ("events", "lineitem"):
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DIR}/{name}.parquet')")
    return found


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, con, name):
    got = catalog.queries()[name](spark, DIR)
    want = con.sql(catalog.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    rows = sorted(str([r[c] for c in order]) for r in got.collect())
    assert rows == sorted(str([r[want.columns.index(c)] for c in order]) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(catalog.queries()) <= set(__spark_entry__.queries())
