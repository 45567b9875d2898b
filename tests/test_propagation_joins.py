"""Few signals go to the edges; many meet them by a shuffle; both give the same signals."""

from datetime import datetime

import pytest

from spanweave.operators import propagation as p

EDGES = "edge_id string, src string, dst string, factor double, valid_from timestamp_ntz, valid_to timestamp_ntz"


@pytest.fixture()
def given(spark):
    rows = [(f"e{a}{b}", f"n{a}", f"n{b}", 0.3 + 0.05 * ((a * b) % 9), None, None) for a in range(8) for b in range(8) if a != b]
    shocks = spark.createDataFrame([("s1", "n0", 0.9, datetime(1998, 1, 1)), ("s2", "n3", 0.5, datetime(1998, 1, 1))], "shock_id string, source string, severity double, starts_at timestamp_ntz")
    return spark.createDataFrame(rows, EDGES), shocks


@pytest.mark.parametrize("how", ["all", "bounded"])
def test_few_signals_shuffle_no_edges(spark, given, monkeypatch, how):
    edges, shocks = given
    run = (lambda: p.propagate(edges, shocks, hops=3)) if how == "all" else lambda: p.propagate_bounded(edges, shocks, hops=3, max_signals=30, paths_an_entity=3)[0]
    told = lambda: sorted((r.shock_id, r.entity, round(r.impairment, 9), r.depth, r.path) for r in run().collect())
    plans, cut = [], p.cut
    monkeypatch.setattr(p, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = told()
        joins = [x for x in plans if "factor" in x and "Join" in x]
        assert joins and all("BroadcastHashJoin" in x and "SortMergeJoin" not in x for x in joins)
        monkeypatch.setattr(p, "FEW", 0, raising=False)
        assert told() == few and any("factor" in x and "SortMergeJoin" in x for x in plans)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
