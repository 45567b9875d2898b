"""Queries of the subpackage that have SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from spanweave.llm import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    df = registry.queries()[name](spark, FOLDER)
    found = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    theirs = sorted(repr([dict(zip(names, r, strict=True))[c] for c in sorted(names)]) for r in found.fetchall())
    assert sorted(repr([r[c] for c in sorted(names)]) for r in df.collect()) == theirs
