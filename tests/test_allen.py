"""Counts of Allen's relations against all pairs."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from spanweave.operators import temporal as t

DAY = datetime(2026, 1, 1)


def relation(a, b):
    (s, e), (u, v) = a, b
    if e < u:
        return "before"
    if e == u:
        return "meets"
    if v < s:
        return "after"
    if v == s:
        return "met_by"
    names = {(0, 0): "equals", (0, -1): "starts", (0, 1): "started_by", (1, 0): "finishes", (-1, 0): "finished_by", (1, -1): "during", (-1, 1): "contains", (-1, -1): "overlaps", (1, 1): "overlapped_by"}
    return names[(s > u) - (s < u), (e > v) - (e < v)]


@pytest.mark.parametrize(("seed", "span"), [(1, 6), (2, 40), (3, 400)])
def test_counts_are_those_of_all_pairs(spark, seed, span):
    draw = random.Random(seed)
    rows = []
    for key, n in (("hot", 150), ("a", 1), ("b", 9), (None, 5)):
        for _ in range(n):
            s = draw.randrange(span)
            rows.append((key, DAY + timedelta(hours=s), DAY + timedelta(hours=s + draw.choice([0, 1, 1, 2, 5, span]))))
    df = spark.createDataFrame(rows, "k string, s timestamp_ntz, e timestamp_ntz").repartition(3)
    want = Counter()
    for i, (k, s, e) in enumerate(rows):
        for j, (q, u, w) in enumerate(rows):
            if i != j and k == q and k is not None and s < e and u < w:
                want[k, relation((s, e), (u, w))] += 1
    got = {(r.k, r.relation): r.n for r in t.allen_counts(df, "k").collect()}
    assert got == dict(want)


def test_no_intervals(spark):
    assert t.allen_counts(spark.createDataFrame([], "k string, s timestamp_ntz, e timestamp_ntz"), "k").count() == 0
