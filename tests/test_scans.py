"""Scans of affine maps against loops."""

import random
from datetime import datetime, timedelta

import pytest

from spanweave.operators import scans

SCHEMA = "key string, at timestamp_ntz, sequence long, value double"


def series(seed, hot=2000):
    """One key with most rows, some with one or two, and one null key."""
    draw = random.Random(seed)
    sizes = {"hot": hot, "a": 1, "b": 2, "c": 3, None: 40, "d": 57, "e": 1, "z": 300}
    rows, k = [], 0
    for key, n in sizes.items():
        for i in range(n):
            k += 1
            rows.append((key, datetime(2026, 1, 1) + timedelta(minutes=i // 2), k, round(draw.gauss(10, 5) + i * 0.01, 3)))
    rows += [("a", datetime(2027, 1, 1), 10**6, None), ("gone", datetime(2027, 1, 1), 1, float("nan"))]
    return rows


def by_key(rows):
    out = {}
    for key, at, sequence, value in sorted((r for r in rows if r[3] is not None and r[3] == r[3]), key=lambda r: (r[1], r[2])):
        out.setdefault(key, []).append(value)
    return out


def plain_holt(x, damp):
    level, trend, off = x[0], x[1] - x[0], []
    for v in x[1:]:
        before = level
        level = 0.35 * v + 0.65 * (level + damp * trend)
        trend = 0.2 * (level - before) + 0.8 * trend
        off.append(v - before - damp * trend)
    centre = sum(off) / len(off)
    scale = max(1e-12, 1.4826 * sorted(abs(r - centre) for r in off)[len(off) // 2])
    return level + damp * trend, scale


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_scans_are_the_loops(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = series(parts)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.key: r.ewma for r in scans.ewma(df, 0.3).collect()}
        holt = {r.key: (r.estimate, r.scale, r.upper - r.lower) for r in scans.holt_linear(df, damp=0.9).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = by_key(rows)
    assert set(got) == set(want) and set(holt) == {k for k, x in want.items() if len(x) > 1}
    for key, x in want.items():
        y = x[0]
        for v in x[1:]:
            y = 0.3 * v + 0.7 * y
        assert got[key] == pytest.approx(y, abs=1e-9)
        if len(x) > 1:
            estimate, scale = plain_holt(x, 0.9)
            assert holt[key][0] == pytest.approx(estimate, abs=1e-8) and holt[key][1] == pytest.approx(scale, abs=1e-8)
            assert holt[key][2] == pytest.approx(2 * 1.2815515655446004 * scale, abs=1e-8)


def test_a_hot_key_runs_over_many_tasks(spark):
    df = spark.createDataFrame([("hot", datetime(2026, 1, 1) + timedelta(seconds=k), k, float(k % 7)) for k in range(4000)], SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = scans.scan(df, scans.ewma_step(0.5))
        assert rows.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(lambda n: n > 0).count() == 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_nothing_to_scan(spark):
    assert scans.ewma(spark.createDataFrame([], SCHEMA), 0.3).count() == 0
    assert scans.holt_linear(spark.createDataFrame([("a", datetime(2026, 1, 1), 1, 2.0)], SCHEMA)).count() == 0


@pytest.mark.parametrize("batch", [2, 3, 5])
def test_runs_that_begin_at_the_end_of_a_batch(spark, batch):
    rows = [(key, datetime(2026, 1, 1) + timedelta(minutes=i), 10 * k + i, float((7 * k + 3 * i * i) % 11)) for k in range(40) for key in (None if k == 0 else f"k{k:02}",) for i in range(1 + k % 5)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {r.key: (r.estimate, r.scale) for r in scans.holt_linear(spark.createDataFrame(rows, SCHEMA), damp=0.9).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {key: plain_holt(x, 0.9) for key, x in by_key(rows).items() if len(x) > 1}
    assert set(got) == set(want)
    for key, pair in want.items():
        assert got[key] == pytest.approx(pair, abs=1e-8)
