"""Bounded propagation against one sequential queue."""

import heapq
import random
from datetime import datetime, timedelta

import pytest

from spanweave.operators import propagation as p

START = datetime(2026, 1, 1)
EDGE = "edge_id string, src string, dst string, factor double, valid_from timestamp_ntz, valid_to timestamp_ntz, delay double"
SHOCK = "shock_id string, source string, severity double, starts_at timestamp_ntz"


def queue(edges, shocks, least, hops, most, paths):
    """The same by a heap; signals as (shock, entity, impairment, depth, at, path, via)."""
    heap, kept, count, processed, reason = [], [], {}, 0, p.QUIESCENT

    def push(shock, entity, x, depth, at, path, via):
        nonlocal reason
        if x < least:
            return
        if count.get(entity, 0) >= paths:
            reason = p.PATHS_REACHED
            return
        count[entity] = count.get(entity, 0) + 1
        kept.append((shock, entity, round(x, 9), depth, at, path, via))
        heapq.heappush(heap, (at, depth, shock, entity, via, path, x))

    for shock, source, severity, at in sorted(shocks, key=lambda r: (r[3], r[0])):
        push(shock, source, severity, 0, at, (source,), ())
    while heap:
        if processed >= most:
            reason = p.SIGNALS_REACHED
            break
        at, depth, shock, entity, via, path, x = heapq.heappop(heap)
        processed += 1
        if depth >= hops:
            continue
        for edge, src, dst, factor, a, b, delay in sorted(edges):
            on = lambda t: (a is None or t >= a) and (b is None or t < b)  # noqa: E731, B023
            then = at + timedelta(seconds=delay)
            if src == entity and dst not in path and factor > 0 and on(at) and on(then):
                push(shock, dst, x * min(1.0, factor), depth + 1, then, (*path, dst), (*via, edge))
    return sorted(kept), processed, reason if kept else p.NOTHING


def bounded(spark, edges, shocks, **bounds):
    signals, ended = p.propagate_bounded(spark.createDataFrame(edges, EDGE).repartition(3), spark.createDataFrame(shocks, SHOCK), **bounds)
    rows = sorted((r.shock_id, r.entity, round(r.impairment, 9), r.depth, r.effective_at, tuple(r.path), tuple(r.via)) for r in signals.collect())
    assert ended.generated == len(rows)
    return rows, ended


@pytest.mark.parametrize(("seed", "most", "paths", "delays"), [(1, 1000, 64, [0]), (2, 25, 3, [0]), (3, 30, 2, [0, 3600, 7200]), (4, 40, 4, [600, 900, 5000]), (5, 7, 1, [1800])])
def test_bounds_are_those_of_a_queue(spark, seed, most, paths, delays):
    draw = random.Random(seed)
    names = "abcdefgh"
    edges = []
    for k in range(22):
        a, b = draw.sample(names, 2)
        edges.append((f"e{k:02}", a, b, draw.choice([0.3, 0.5, 0.8, 1.0]), None if draw.random() < 0.8 else START + timedelta(hours=1), None if draw.random() < 0.8 else START + timedelta(hours=3), float(draw.choice(delays))))
    shocks = [("s2", "a", 0.9, START), ("s1", "b", 0.7, START), ("s3", "a", 0.6, START + timedelta(minutes=20)), ("s4", "c", 0.001, START)]
    got, ended = bounded(spark, edges, shocks, least=0.1, hops=4, max_signals=most, paths_an_entity=paths)
    want, processed, reason = queue(edges, shocks, 0.1, 4, most, paths)
    assert got == want and ended.processed == processed and ended.reason == reason
    assert ended.status == ("complete" if reason == p.QUIESCENT else "truncated")


def test_one_signal_is_processed_and_nothing_sets_out(spark):
    edges = [("r1", "a", "b", 0.9, None, None, 0.0)]
    got, ended = bounded(spark, edges, [("s1", "a", 0.8, START)], max_signals=1)
    assert (ended.status, ended.reason, ended.processed, len(got)) == ("truncated", p.SIGNALS_REACHED, 1, 2)
    got, ended = bounded(spark, edges, [("s1", "a", 0.0, START)])
    assert (ended.status, ended.processed, got) == ("no_initial_signal", 0, [])
