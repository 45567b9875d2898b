"""Topological levels of long chains, of chains that meet, and of cycles."""

import random

import pytest

from spanweave.operators import graph as g


def levels(spark, nodes, edges):
    rows = g.topological_levels(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "src string, dst string")).collect()
    assert len(rows) == len(set(nodes))
    return {r.node: r.level for r in rows}


def plain(nodes, edges):
    above = {n: {a for a, b in edges if b == n} for n in nodes}
    known = {}
    while len(known) < len(above):
        free = [n for n in above if n not in known and all(a in known for a in above[n])]
        if not free:
            return None
        known.update({n: max((known[a] + 1 for a in above[n]), default=0) for n in free})
    return known


def test_long_chain(spark):
    nodes = [f"n{k:03}" for k in range(200)]
    assert levels(spark, nodes, list(zip(nodes, nodes[1:], strict=False))) == {n: k for k, n in enumerate(nodes)}


@pytest.mark.parametrize("edges", [[("a", "b"), ("b", "c"), ("c", "a")], [("r", "a"), ("a", "b"), ("b", "a")], [("r", "a"), ("r", "b"), ("a", "b"), ("b", "c"), ("c", "a")], [("a", "a")]])
def test_cycle_is_an_error(spark, edges):
    with pytest.raises(ValueError, match="cycle"):
        levels(spark, ["r", "a", "b", "c"], edges)


@pytest.mark.parametrize("seed", range(4))
def test_levels_are_the_plain_ones(spark, seed):
    draw = random.Random(seed)
    nodes = [str(k) for k in range(40)]
    edges = [(str(a), str(b)) for b in range(40) for a in draw.sample(range(b), min(b, draw.choice([0, 1, 1, 1, 2, 3])))]
    assert levels(spark, nodes + nodes[:3], edges + edges[:5]) == plain(nodes, edges)


def test_no_edges_and_no_nodes(spark):
    assert levels(spark, ["a", "b"], []) == {"a": 0, "b": 0}
    assert levels(spark, [], []) == {}
