import duckdb
import pytest

import __spark_entry__ as entry
import check
from tallybrook.plans import catalog, oracle

NAMES = sorted(catalog.QUERIES)


def _views(sf):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def db():
    return _views("/root/testdata/sf0.001")


def test_every_query_has_sql():
    assert set(oracle.sql()) == set(NAMES)


def test_all_are_registered():
    assert set(NAMES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, db, name):
    df = entry.queries()[name](spark, sf)
    cur = db.execute(entry.oracle_sql()[name])
    want = check.canonical([d[0] for d in cur.description], cur.fetchall())
    assert check.canonical(df.columns, df.collect()) == want


@pytest.mark.parametrize("name", ["dead_letter_routing", "dead_letter_replay"])
def test_rare_failures_meet_in_more_rows(spark, name):
    """Rows that fail in two ways at once occur only in the larger tables."""
    sf = "/root/testdata/sf0.01"
    df, cur = entry.queries()[name](spark, sf), _views(sf).execute(entry.oracle_sql()[name])
    want = check.canonical([d[0] for d in cur.description], cur.fetchall())
    assert check.canonical(df.columns, df.collect()) == want


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0
