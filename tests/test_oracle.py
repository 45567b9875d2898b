"""Every query of the catalogue against its DuckDB twin on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from spanweave import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return "nan" if x != x else round(x, 5)
    if isinstance(x, decimal.Decimal):
        return round(float(x), 5)
    if isinstance(x, list):
        return tuple(map(plain, x))
    return str(x) if isinstance(x, (datetime.date, datetime.datetime)) else x


@pytest.mark.parametrize("key", sorted(catalog.queries()))
def test_same_rows(spark, duck, key):
    df = catalog.queries()[key](spark, FOLDER)
    ours = [dict(zip(df.columns, r, strict=True)) for r in df.collect()]
    sql = catalog.oracle_sql().get(key)
    if sql is None:
        assert df.columns
        return
    found = duck.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    theirs = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    as_rows = lambda rows: sorted(repr([plain(r[c]) for c in sorted(names)]) for r in rows)
    assert as_rows(ours) == as_rows(theirs)
