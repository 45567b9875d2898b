"""Known values and properties of operators that SQL does not express, and of their edge cases."""

import math
import random
from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.operators import economics as ec
from spanweave.operators import evidence as ev
from spanweave.operators import geodesy as gd
from spanweave.operators import graph as g
from spanweave.operators import propagation as p
from spanweave.operators import spatial as sp
from spanweave.operators import stats as st
from spanweave.operators import temporal as t
from spanweave.operators import workflow as wf
from spanweave.sources import formats


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, weight double")


def test_pagerank_with_sink(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    got = dict(g.pagerank(nodes, edges(spark, [("a", "b", 1.0)]), 60, renormalise=True).collect())
    x = 0.5
    for _ in range(200):
        a, b = x, 1 - x
        x = 0.075 + 0.85 * b / 2
    assert got["a"] == pytest.approx(x, abs=1e-9) and sum(got.values()) == pytest.approx(1)


def test_max_flow_and_cut(spark):
    e = edges(spark, [("s", "a", 3.0), ("s", "b", 2.0), ("a", "t", 2.0), ("b", "t", 3.0), ("a", "b", 5.0)])
    value, flows, side = g.max_flow(e, "s", "t")
    assert value == pytest.approx(5.0) and "s" in side and "t" not in side


def test_articulation_against_removal(spark):
    rng = random.Random(3)
    for _ in range(5):
        rows = sorted({tuple(sorted(rng.sample("abcdefgh", 2))) for _ in range(9)})
        got = {r.node for r in g.articulation_points(edges(spark, [(a, b, 1.0) for a, b in rows])).collect()}

        def parts(skip):
            left = {x for r in rows for x in r} - {skip}
            n = 0
            while left:
                n += 1
                todo = [left.pop()]
                while todo:
                    x = todo.pop()
                    near = {b if a == x else a for a, b in rows if x in (a, b)} & left
                    left -= near
                    todo += near
            return n

        names = {x for r in rows for x in r}
        assert got == {x for x in names if parts(x) > parts(None) - (not any(x in r for r in rows))}


def test_betweenness_of_a_path(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "node string")
    got = dict(g.betweenness(nodes, edges(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)])).collect())
    assert got == pytest.approx({"a": 0.0, "b": 2 / 6, "c": 2 / 6, "d": 0.0})


def test_strong_components(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "node string")
    got = dict(g.strong_components(nodes, edges(spark, [("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("d", "e", 1.0), ("e", "c", 1.0)])).collect())
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "c", "f": "f"}


def test_ancestors_of_a_long_chain_and_a_cycle(spark):
    rows = [(f"n{k}", f"n{k - 1}" if k else None) for k in range(200)] + [("x", "y"), ("y", "z"), ("z", "x")]
    got = {r["node"]: r["count"] for r in ev.ancestors(spark.createDataFrame(rows, "node string, parent string")).groupBy("node").count().collect()}
    assert got == {f"n{k}": k for k in range(1, 200)} | {"x": 3, "y": 3, "z": 3}


def test_shortest_on_a_long_chain(spark):
    got = g.shortest(edges(spark, [(f"n{k}", f"n{k + 1}", 1.0) for k in range(36)]), "n0", "weight").collect()
    assert {r.node: r.cost for r in got} == {f"n{k}": float(k) for k in range(37)}


def test_depth_first_marks_on_push(spark):
    e = edges(spark, [("a", "b", 1.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)])
    assert [r.node for r in g.depth_first(e, "a").orderBy("place").collect()] == ["a", "b", "c", "d"]


def test_cycle_is_an_error(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    with pytest.raises(ValueError):
        g.topological_levels(nodes, edges(spark, [("a", "b", 1.0), ("b", "a", 1.0)]))


def test_propagation_edges_need_to_be_active(spark):
    day = datetime(2026, 1, 1)
    e = spark.createDataFrame([("a", "b", 0.5, day, None), ("b", "c", 0.5, day + timedelta(days=1), None), ("a", "d", 0.001, None, None)], "src string, dst string, factor double, valid_from timestamp_ntz, valid_to timestamp_ntz")
    s = spark.createDataFrame([("x", "a", 0.8, day)], "shock_id string, source string, severity double, starts_at timestamp_ntz")
    assert {(r.entity, round(r.impairment, 6)) for r in p.propagate(e, s).collect()} == {("a", 0.8), ("b", 0.4)}
    late = p.propagate(e, s, delay_seconds=86400.0)
    assert {r.entity for r in late.collect()} == {"a", "b", "c"}


def test_noisy_or_and_caps(spark):
    s = spark.createDataFrame([("a", 0.5), ("a", 0.8), ("b", 0.0)], "entity string, impairment double")
    assert dict(p.capacities(s, "noisy_or").select("entity", F.round("impairment", 9)).collect()) == {"a": 0.9, "b": 0.0}
    assert dict(p.capacities(s, "sum_cap").select("entity", "impairment").collect()) == {"a": 1.0, "b": 0.0}


def test_allen_has_inverses(spark):
    spans = [(a, b) for a in range(4) for b in range(a + 1, 5)]
    df = spark.createDataFrame([(*x, *y) for x in spans for y in spans], "a int, b int, c int, d int")
    inverse = {"before": "after", "meets": "met_by", "overlaps": "overlapped_by", "starts": "started_by", "during": "contains", "finishes": "finished_by", "equals": "equals"}
    inverse |= {y: x for x, y in inverse.items()}
    rows = df.select(t.allen(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("x"), t.allen(F.col("c"), F.col("d"), F.col("a"), F.col("b")).alias("y")).collect()
    assert all(inverse[r.x] == r.y for r in rows) and len({r.x for r in rows}) == 13


def test_month_ends(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 31),)], "x timestamp_ntz")
    assert df.select(t.step(F.col("x"), "month", 1)).first()[0] == datetime(2024, 2, 29)


def test_interval_join_counts_each_pair_once(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        s = datetime(2020, 1, 1) + timedelta(hours=rng.randrange(2000))
        rows.append((i, s, s + timedelta(hours=rng.randrange(1, 900))))
    df = spark.createDataFrame(rows, "id int, s timestamp_ntz, e timestamp_ntz")
    got = sorted((r.l_id, r.r_id) for r in t.interval_join(df, df, 7).collect())
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[1] < b[2] and b[1] < a[2])


def test_geodesic_known_values():
    got, *_ = gd.inverse(np.array([0.0, 0.0, 10.0]), np.array([0.0, 0.0, 10.0]), np.array([0.0, 90.0, 10.0]), np.array([1.0, 0.0, 10.0]))
    assert got[0] == pytest.approx(111319.49079327357, abs=1e-3) and got[1] == pytest.approx(10001965.729, abs=1e-2) and got[2] == 0


def test_whole_earth_area():
    half = sp.ring_area_m2(np.array([0.0, 0.0, 0.0, 0.0]), np.array([0.0, 90.0, 180.0, -90.0]))
    assert half == pytest.approx(0, abs=1) or half > 0
    square = sp.ring_area_m2(np.array([0.0, 0.0, 1.0, 1.0]), np.array([0.0, 1.0, 1.0, 0.0]))
    assert square == pytest.approx(1.2308778e10, rel=1e-4)


def test_radius_join_at_poles_and_antimeridian(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([-89.9, 89.5, 0.0, 60.0]) + rng.uniform(-0.4, 0.4), rng.choice([-179.9, 179.9, 0.0, 90.0]) + rng.uniform(-0.1, 0.1)) for i in range(80)]
    rows = [(i, max(-90.0, min(90.0, a)), b) for i, a, b in rows]
    df = spark.createDataFrame(rows, "id int, lat double, lon double")
    got = {(r.l_id, r.r_id) for r in sp.within_km(df, df, 150.0).collect()}

    def km(a, b):
        p1, p2 = math.radians(a[1]), math.radians(b[1])
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * sp.RADIUS_KM * math.asin(min(1, math.sqrt(h)))

    assert got == {(a[0], b[0]) for a in rows for b in rows if km(a, b) <= 150}


def test_knapsacks_against_all_subsets():
    rng = random.Random(4)
    for _ in range(20):
        items = [(f"i{k}", float(rng.randrange(1, 20)), float(rng.randrange(1, 30))) for k in range(9)]
        best = max(sum(x[2] for k, x in enumerate(items) if m >> k & 1) for m in range(512) if sum(x[1] for k, x in enumerate(items) if m >> k & 1) <= 40)
        names, status = ec.knapsack(items, 40.0)
        assert status == "optimal" and sum(x[2] for x in items if x[0] in names) == best
        assert ec.integer_knapsack([(a, int(b), c) for a, b, c in items], 40)[1] == best


def test_leontief_and_divergence(spark):
    one = spark.createDataFrame([("m", "x", "x", 0.2, 10.0)], "model string, i string, j string, a double, d double")
    assert ec.leontief(one).first().output == pytest.approx(12.5)
    with pytest.raises(Exception):
        ec.leontief(one.withColumn("a", F.lit(1.5))).collect()


def test_money_is_exact(spark):
    rates = {("USD", "EUR"): Decimal("0.9"), ("EUR", "CHF"): Decimal("1.1")}
    f = ec.convert_money(rates, "CHF", "USD")
    df = spark.createDataFrame([(Decimal("99.00"),), (None,)], "x decimal(18,2)")
    assert [r[0] for r in df.select(f("x")).collect()] == [Decimal("100.000000"), None]


def test_cusum_and_holt(spark):
    df = spark.createDataFrame([([0.0, 10.0, 10.0, 0.0, 10.0],)], "v array<double>")
    assert df.select(st.cusum("v", 0.0, 1.0, 15.0)).first()[0] == [2]
    pts = spark.createDataFrame([(1, i, i, float(i)) for i in range(5)], "key int, at int, sequence int, value double")
    assert st.holt(pts).first().scale >= 0


def test_normalised_text_and_ids(spark):
    df = spark.createDataFrame([("Ａ  b C",), (None,)], "x string")
    assert [r[0] for r in df.select(ev.nfkc()("x")).collect()] == ["a b c", None]
    assert ev.canonical_json({"b": 1, "a": [1.5, None, "é"]}) == '{"a":[1.5,null,"é"],"b":1}'


def test_graph_files(spark, tmp_path):
    v = spark.createDataFrame([("a",), ("b",)], "node string")
    e = edges(spark, [("a", "b", 0.5)])
    formats.write_graph(v, e, str(tmp_path / "g"))
    v2, e2 = formats.read_graph(spark, str(tmp_path / "g"), v.schema, e.schema)
    assert v2.count() == 2 and e2.first().weight == 0.5


def test_pipeline_order_and_retry():
    seen = []
    fails = iter([True, False])

    def flaky(_):
        if next(fails):
            raise RuntimeError
        return 1

    tasks = [wf.Task("b", lambda r: seen.append("b"), ("a",)), wf.Task("a", flaky, retries=1), wf.Task("c", lambda r: r["a"] + 1, ("b",))]
    assert wf.Pipeline(tasks).order == ["a", "b", "c"]
    assert wf.Pipeline(tasks).execute()["c"] == 2
    with pytest.raises(ValueError):
        wf.Pipeline([wf.Task("a", flaky, ("b",)), wf.Task("b", flaky, ("a",))])
    s = wf.Schedule(datetime(2026, 1, 1), timedelta(hours=1))
    assert len(list(s.due(datetime(2026, 1, 1, 2)))) == 3 and not list(s.due(datetime(2026, 1, 1, 2)))


def test_interval_join_open_bounds(spark):
    """A null bound is open: three intervals that overlap pairwise give three pairs, and open ends stay open."""
    from spanweave.operators import temporal

    rows = [(1, None, "1998-01-05"), (2, "1998-01-01", None), (3, None, None), (4, "1999-01-01", "1999-02-01")]
    df = spark.createDataFrame(rows, "id long, s string, e string").selectExpr("id", "cast(s as timestamp_ntz) s", "cast(e as timestamp_ntz) e")
    got = {(r.l_id, r.r_id): (r.s and str(r.s)[:10], r.e and str(r.e)[:10]) for r in temporal.interval_join(df, df, 30).where("l_id < r_id").collect()}
    assert got == {(1, 2): ("1998-01-01", "1998-01-05"), (1, 3): (None, "1998-01-05"), (2, 3): ("1998-01-01", None), (2, 4): ("1999-01-01", "1999-02-01"), (3, 4): ("1999-01-01", "1999-02-01")}


def test_propagation_by_edge_delay_and_kind(spark):
    from pyspark.sql import functions as F

    from spanweave.operators import propagation

    edges = spark.createDataFrame([("a", "b", 0.5, "x", 3600.0), ("b", "c", 0.5, "x", 60.0), ("a", "d", 0.9, "y", 0.0)], "src string, dst string, factor double, kind string, delay double")
    edges = edges.withColumns({"valid_from": F.lit(None).cast("timestamp_ntz"), "valid_to": F.lit(None).cast("timestamp_ntz")})
    shocks = spark.createDataFrame([("s", "a", 1.0)], "shock_id string, source string, severity double").withColumn("starts_at", F.lit("1998-01-01").cast("timestamp_ntz"))
    got = {r.entity: (r.impairment, str(r.effective_at)) for r in propagation.propagate(edges, shocks, kinds=["x"]).collect()}
    assert got == {"a": (1.0, "1998-01-01 00:00:00"), "b": (0.5, "1998-01-01 01:00:00"), "c": (0.25, "1998-01-01 01:01:00")}


def test_ranks_by_counted_values(spark):
    """Ranks, worst means and average ranks over counted values against sorting each group."""
    import random

    from pyspark.sql import functions as F

    from spanweave.operators import stats

    rng = random.Random(6)
    rows = [(g, float(rng.randrange(20))) for g in ("a", "b", "c") for _ in range(rng.randrange(1, 200))]
    df = spark.createDataFrame(rows, "g string, x double")
    groups = {g: sorted(x for h, x in rows if h == g) for g in "abc"}
    got = dict(stats.rank_value(df, ["g"], "x", F.ceil(F.col("_all") * 0.3), "m").collect())
    assert got == {g: v[max(1, -(-len(v) * 3 // 10)) - 1] for g, v in groups.items()}
    for g, cvar, floor in stats.worst_mean(df, ["g"], "x", 0.9).collect():
        k = max(1, int(len(groups[g]) * (1 - 0.9) + 0.999999))
        assert abs(cvar - sum(groups[g][:k]) / k) < 1e-9 and floor == groups[g][0]
    for g, x, r in stats.average_ranks(df, ["g"], "x", "r").collect():
        at = [i + 1 for i, y in enumerate(groups[g]) if y == x]
        assert r == sum(at) / len(at)


def test_distance_of_unknown_points(spark):
    from pyspark.sql import functions as F

    from spanweave.operators import spatial

    row = spark.range(1).select(spatial.haversine_km(F.lit(None).cast("double"), F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("a"), spatial.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("b")).first()
    assert row.a is None and abs(row.b - 20015.1144) < 0.01


def test_geodesics_beside_the_equator_to_near_antipodes_are_told_to_a_micrometre():
    lat = np.array([0.015416271344292909, -0.0014619964349549264, 1e-7, -0.3])
    lon = np.array([-34.268124997615814, -8.148186206817627, 5.0, 12.0])
    lat2, lon2 = -lat, lon + np.array([179.2, 179.0, 178.0, 179.3])
    metres, azimuth, *_ = gd.inverse(lat, lon, lat2, lon2)
    there = gd.direct(lat, lon, azimuth, metres)
    # As arcs of the sphere: the inverse itself is not asked.
    off = 6.4e6 * np.radians(np.hypot(there[0] - lat2, np.mod(there[1] - lon2 + 180, 360) - 180))
    assert off.max() < 1e-6
