"""What is not done twice, or not held at once."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from spanweave.operators import evidence as ev
from spanweave.operators import graph as g
from spanweave.queries import more

SMALL = "/root/testdata/sf0.001"


def test_trade_edges_are_made_once_for_their_digest(spark, monkeypatch):
    """a28_graph_digest reads its edges several times; they are made once."""
    made = spark.sparkContext.accumulator(0)
    rows = [("A", "B", 0.5), ("B", "C", 0.25), ("C", "A", 0.75)]

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    edges = spark.createDataFrame(rows, "src string, dst string, weight double").mapInArrow(count, "src string, dst string, weight double")
    monkeypatch.setattr(more.v, "trade_edges", lambda s, d: edges)
    assert [tuple(r) for r in more.a28_graph_digest(spark, SMALL).collect()] == [(True, 25, 3)]
    assert made.value == 3


def test_levels_of_the_nodes_that_edges_have(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "c"), ("c", "e"), ("c", None), (None, "a")], "src string, dst string")
    told = lambda nodes: {r.node: r.level for r in g.topological_levels(nodes, edges).collect()}
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    assert told(None) == told(nodes) == {"a": 0, "b": 1, "c": 2, "d": 0, "e": 3}


def test_nfkc_holds_few_texts_at_once(spark, monkeypatch):
    texts = [None if k % 7 == 0 else f"Ａ {k} ﬁ　" * (k % 1600) for k in range(6000)]
    want = [None if x is None else " ".join(f"a {k} fi" for _ in range(k % 1600)) for k, x in enumerate(texts)]
    run, given = ev.nfkc().func, pa.array(texts)
    tracemalloc.start()
    got = run(given)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == want
    assert peak < 8 << 20 < sum(len(x or "") for x in texts)
    monkeypatch.setattr(ev, "NFKC_BYTES", 5)
    assert ev.nfkc().func(pa.array(texts[:20])).to_pylist() == want[:20] and len(run(pa.array([], pa.string()))) == 0
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts[:50])], "k int, x string")
    assert [r[1] for r in rows.select("k", ev.nfkc()(F.col("x"))).orderBy("k").collect()] == want[:50]
