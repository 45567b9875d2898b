"""Queries of the trade graph on tables whose trade is so even that no share makes an edge."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from spanweave.operators import graph

FROM = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The smallest tables, without lines: no exporter has a share over 0.05."""
    path = tmp_path_factory.mktemp("even")
    for name in os.listdir(FROM):
        if name != "lineitem.parquet":
            os.symlink(f"{FROM}/{name}", path / name)
    duckdb.sql(f"COPY (SELECT * FROM '{FROM}/lineitem.parquet' LIMIT 0) TO '{path}/lineitem.parquet' (FORMAT parquet)")
    return str(path)


def rows(spark, folder, key):
    return [tuple(r) for r in entry.queries()[key](spark, folder).collect()]


def test_depth_first(spark, folder):
    assert rows(spark, folder, "g04_dfs") == []


def test_max_flow(spark, folder):
    assert rows(spark, folder, "g22_max_flow") == []
    one = spark.createDataFrame([("a", "a", 1.0)], "src string, dst string, weight double")
    assert graph.max_flow(one, "a", "a") == (0.0, [("a", "a", 0.0)], set())


def sql(folder, key):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{name}')")
    found = con.execute(entry.oracle_sql()[key])
    return [c[0] for c in found.description], found.fetchall()


@pytest.mark.parametrize("key", ["g05_bfs_labels", "g12_shortest_labels"])
def test_labels_are_those_of_the_sql(spark, folder, key):
    names, theirs = sql(folder, key)
    df = entry.queries()[key](spark, folder)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(theirs)
