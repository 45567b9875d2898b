"""Few signals ask for the edges that leave their entities; all edges are made for many, or after some levels, once."""

from datetime import datetime

import pytest

from spanweave import catalog
from spanweave import views as v
from spanweave.operators import propagation as p
from spanweave.queries import impact

FOLDER = "/root/testdata/sf0.01"
SHARING = ["p01_propagate", "a09_evidence_counts", "c01_continuity", "c02_recovery", "c03_substitution", "io10_result_tables", "p08_outcome", "p01_bounded"]


def moved(spark):
    """Rows that all stages so far shuffled and wrote."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() + stages.apply(i).outputRecords() for i in range(stages.size()))


@pytest.mark.parametrize("key", SHARING)
def test_rows_that_no_signal_reaches_are_neither_shuffled_nor_written(spark, key):
    lines = v.table(spark, FOLDER, "lineitem").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        before = moved(spark)
        catalog.queries()[key](spark, FOLDER).collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        assert moved(spark) - before < lines / 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_edges_of_few_entities_are_those_among_all(spark):
    every = impact.edges(spark, FOLDER)
    names = ["supplier:3", "supplier:5", "part:7", "part:11", "part:07", "customer:2", "part:x", "other", None]
    of = spark.createDataFrame([(x,) for x in names + names[:3]], "src string")
    told = lambda df: sorted(tuple(r) for r in df.collect())
    want = told(every.where(every.src.isin([x for x in names if x])))
    assert {r[1] for r in want} == {"supplier:3", "supplier:5", "part:7", "part:11"}
    assert told(impact.edges(spark, FOLDER, of)) == want
    assert told(impact.edges(spark, FOLDER, of.limit(0))) == []


@pytest.mark.parametrize("how", ["all", "bounded"])
@pytest.mark.parametrize("given", ["rows", "function"])
def test_all_edges_are_made_once_at_most(spark, monkeypatch, how, given):
    """A chain of 6 nodes with shortcuts, longer than LEVELS."""
    rows = [(f"e{a}{b}", f"n{a}", f"n{b}", 0.9, None, None) for a in range(6) for b in (a + 1, a + 3) if b < 6]
    table = spark.createDataFrame(rows, "edge_id string, src string, dst string, factor double, valid_from timestamp_ntz, valid_to timestamp_ntz")
    shocks = spark.createDataFrame([("s1", "n0", 0.9, datetime(1998, 1, 1)), ("s2", "n2", 0.5, datetime(1998, 1, 1))], "shock_id string, source string, severity double, starts_at timestamp_ntz")
    asked, kept, written = [], [], p.written
    monkeypatch.setattr(p, "written", lambda df, name: (kept.append(name), written(df, name))[1])

    def some(of=None):
        asked.append(of is None)
        return table if of is None else table.join(of.distinct(), "src", "left_semi")

    edges = table if given == "rows" else some
    told = lambda: sorted((r.shock_id, r.entity, round(r.impairment, 9), r.depth, r.path) for r in (p.propagate(edges, shocks) if how == "all" else p.propagate_bounded(edges, shocks)[0]).collect())
    runs = {}
    for few, levels in ((50_000, 2), (50_000, 100), (0, 2)):
        monkeypatch.setattr(p, "FEW", few)
        monkeypatch.setattr(p, "LEVELS", levels)
        asked.clear(), kept.clear()
        runs[few, levels] = told()
        assert len(kept) == (0 if (few, levels) == (50_000, 100) else 1)
        if given == "function":
            assert asked.count(False) == {2: 2 if few else 0}.get(levels, asked.count(False))
    assert len({str(x) for x in runs.values()}) == 1 and max(r[3] for r in runs[0, 2]) == 5
