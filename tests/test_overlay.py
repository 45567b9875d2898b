"""Overlays against membership of points and against closed forms."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spanweave.operators import overlay as ov


def polygons(spark, rows):
    """Rows (id, ring of (lon, lat))."""
    data = [(k, [{"lat": float(y), "lon": float(x)} for x, y in ring]) for k, ring in rows]
    return spark.createDataFrame(data, "id long, ring array<struct<lat: double, lon: double>>")


def inside(rings, x, y):
    n = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            n += (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
    return n % 2 == 1


def star(draw, x, y, size, corners):
    angles = sorted(draw.uniform(0, 2 * math.pi) for _ in range(corners))
    return [(x + size * draw.uniform(0.3, 1) * math.cos(t), y + size * draw.uniform(0.3, 1) * math.sin(t)) for t in angles]


def overlaid(spark, one, two):
    a, b = ov.ring_edges(polygons(spark, one)), ov.ring_edges(polygons(spark, two))
    pairs = ov.candidates(ov.boxes(a), ov.boxes(b))
    return ov.arrangement(ov.paired(pairs, a, b), ov.PAIR)


def result_rings(outline, keys):
    out = {}
    for r in ov.rings(outline, keys).collect():
        out.setdefault(tuple(r[k] for k in keys), []).append([(p.lon, p.lat) for p in r.ring])
    return out


def shoelace(rings):
    return sum((ax * by - bx * ay) / 2 for ring in rings for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True))


@pytest.mark.parametrize("seed", range(3))
def test_results_hold_the_right_points(spark, seed):
    draw = random.Random(seed)
    one = [(k, star(draw, draw.uniform(-5, 5), draw.uniform(-5, 5), 6, 9)) for k in range(3)]
    hole = [(2, [(x * 0.2 + 1, y * 0.2) for x, y in one[2][1]])]
    cross = [(9, [(-6, -6), (6, 6), (-6, 6), (6, -6)])]  # crosses itself
    two = [(10 + k, star(draw, draw.uniform(-5, 5), draw.uniform(-5, 5), 6, 9)) for k in range(2)] + cross
    one = one + hole
    arranged = overlaid(spark, one, two)
    results = result_rings(ov.outlines(arranged, ov.PAIR, ov.rules()), ["a", "b", "kind"])
    ring_of = {}
    for k, ring in one + two:
        ring_of.setdefault(k, []).append(ring)
    areas = {(r.a, r.b, r.kind): r.area for r in ov.outlines(arranged, ov.PAIR, ov.rules()).groupBy("a", "b", "kind").agg(ov.area().alias("area")).collect()}
    for a in {k for k, _ in one}:
        for b in {k for k, _ in two}:
            for _ in range(150):
                x, y = draw.uniform(-12, 12), draw.uniform(-12, 12)
                in_a, in_b = inside(ring_of[a], x, y), inside(ring_of[b], x, y)
                want = {"intersection": in_a and in_b, "union": in_a or in_b, "difference": in_a and not in_b}
                for kind, is_in in want.items() if (a, b, "union") in results else [("intersection", in_a and in_b)]:  # boxes that are apart make no pair
                    assert inside(results.get((a, b, kind), []), x, y) == is_in, (a, b, kind, x, y)
            of = lambda kind: areas.get((a, b, kind), 0.0)  # noqa: E731, B023
            assert of("intersection") == pytest.approx(shoelace(results.get((a, b, "intersection"), [])), abs=1e-6)
            assert of("intersection") >= -1e-9 and of("difference") >= -1e-9
            assert of("union") - of("difference") == pytest.approx(abs(of("union") - of("difference")), abs=1e-9)
    for a, b, _ in areas:
        whole = areas.get((a, b, "difference"), 0.0) + areas.get((a, b, "intersection"), 0.0)
        others = [areas.get((a, c, "difference"), 0.0) + areas.get((a, c, "intersection"), 0.0) for c in (10, 11, 9) if any(k[:2] == (a, c) for k in areas)]
        assert all(o == pytest.approx(whole, abs=1e-6) for o in others)


def box(w, s, e, n):
    return [(w, s), (e, s), (e, n), (w, n)]


def test_boxes_in_every_position(spark):
    """Closed forms of areas and relations, for shared edges, corners and equal boxes too."""
    one = [(0, box(0, 0, 4, 4))]
    others = [box(0, 0, 4, 4), box(1, 1, 2, 2), box(-1, -1, 5, 5), box(4, 0, 6, 4), box(4, 4, 5, 5), box(2, 2, 6, 6), box(0, 1, 2, 3), box(5, 5, 6, 6), box(0, 0, 4, 2), box(-3, 1, 7, 2), box(4, 1, 6, 2)]
    two = [(k + 1, b[::-1] if k % 2 else b) for k, b in enumerate(others)]
    arranged = overlaid(spark, one, two)
    got = {(r.b, r.kind): r.area for r in ov.outlines(arranged, ov.PAIR, ov.rules()).groupBy("b", "kind").agg(ov.area().alias("area")).collect()}
    told = {r.b: (r.intersects, r.touches, r.covers, r.within, r.equals) for r in ov.relations(arranged).collect()}
    for k, b in enumerate(others):
        (w, s), (e, n) = b[0], b[2]
        dx, dy = min(4, e) - max(0, w), min(4, n) - max(0, s)
        both = dx * dy if dx > 0 and dy > 0 else 0
        size = (e - w) * (n - s)
        if dx < 0 or dy < 0:
            assert k + 1 not in told
            continue
        for kind, want in (("intersection", both), ("union", 16 + size - both), ("difference", 16 - both)):
            assert got.get((k + 1, kind), 0.0) == pytest.approx(want, abs=1e-6)
        assert told[k + 1] == (True, both == 0, both == size, both == 16, both == size == 16)


def test_related_pairs_are_arranged_only_near_each_other(spark, monkeypatch):
    draw = random.Random(7)
    spots = [(draw.uniform(-9, 9), draw.uniform(-9, 9)) for _ in range(25)]
    one = [(0, star(draw, 0, 0, 10, 9)), (1, box(-8, -8, 8, 8)), (1, box(-3, -3, 3, 3)), (2, [(-8, -1), (8, -1), (8, 1), (-8, 1)]), (3, [(-5, 0), (5, 0), (-5, 0)]), (4, box(175, 2, 185, 8)), (5, box(-6, -6, 6, 6)), (5, box(-6, -6, 6, 6))]
    two = [(k, star(draw, x, y, 1, 5)) for k, (x, y) in enumerate(spots)] + [(50, box(-2, -2, 2, 2)), (51, box(-3, -3, 3, 3)), (52, box(-9, -9, 9, 9)), (53, box(-1, -8, 1, 8)), (54, box(-180, 3, -178, 4)), (55, [(1, 1), (2, 2), (1, 1)]), (56, box(-8, 8, 8, 9)), (57, box(6, -1, 7, 1))]
    a, b = ov.ring_edges(polygons(spark, one)), ov.ring_edges(polygons(spark, two))
    pairs = ov.candidates(ov.boxes(a), ov.boxes(b)).localCheckpoint()
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    want, asked = rows(ov.relations(ov.arrangement(ov.paired(pairs, a, b), ov.PAIR))), []
    paired = ov.paired
    monkeypatch.setattr(ov, "paired", lambda near, *edges: asked.append(near.count()) or paired(near, *edges))
    assert rows(ov.related(pairs, a, b)) == want and any(r[4] for r in want) and not all(r[2] for r in want)
    assert sum(asked) < 0.6 * pairs.count()


def test_across_the_date_line(spark):
    one = [(1, [(170, 0), (-170, 0), (-170, 10), (170, 10)]), (2, box(-179, 2, -175, 4)), (3, box(175, 2, 179, 4)), (4, box(0, 0, 10, 10))]
    arranged = overlaid(spark, one, one)
    got = {(r.a, r.b): r for r in ov.relations(arranged).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 4), (1, 2), (2, 1), (1, 3), (3, 1)}
    assert got[1, 2].covers and got[2, 1].within and got[1, 3].covers and got[1, 1].equals and not got[1, 2].equals
    area = {(r.a, r.b): r.area for r in ov.outlines(arranged, ov.PAIR, {"i": F.col("in_a") & F.col("in_b")}).groupBy("a", "b").agg(ov.area().alias("area")).collect()}
    assert area[1, 1] == pytest.approx(200) and area[1, 2] == pytest.approx(8) and area[3, 1] == pytest.approx(8)


def test_union_of_many(spark):
    """Squares of a chess board, rings within rings and boxes that overlap: dissolved tile by tile."""
    rows = [(k, box(k % 6, k // 6, k % 6 + 1, k // 6 + 1)) for k in range(36) if k not in (14, 21)]
    rows += [(100 + k, box(20 + k, 20 + k, 22 + k, 22 + k)) for k in range(5)] + [(200, box(20, 20, 22, 22))]
    edges = ov.ring_edges(polygons(spark, rows)).withColumn("group", F.when(F.col("id") < 100, "board").otherwise("stairs"))
    done = ov.dissolved(edges, levels=3, size=2.0)
    got = {r.group: (r.area, r.n) for r in done.groupBy("group").agg(ov.area().alias("area"), F.count("*").alias("n")).collect()}
    assert got["board"][0] == pytest.approx(34) and got["stairs"][0] == pytest.approx(4 + 4 * 3)
    found = result_rings(done, ["group"])
    assert len(found["board",]) in (2, 3) and len(found["stairs",]) == 1
    for k in range(36):
        assert inside(found["board",], k % 6 + 0.5, k // 6 + 0.5) == (k not in (14, 21))


def test_union_starts_in_small_tiles(spark, monkeypatch):
    """Boxes of whole corners that overlap in one large tile, one of them forty times: few meet in a first tile, and copies are taken once."""
    first, arrangement = [], ov.arrangement
    monkeypatch.setattr(ov, "arrangement", lambda edges, keys: (first.append((edges.count(), edges.select(*keys).distinct().count())), arrangement(edges, keys))[1])
    draw = random.Random(4)
    corners = [(1, 1)] * 40 + list({(draw.randrange(12), draw.randrange(12)) for _ in range(60)} - {(1, 1)})
    edges = ov.ring_edges(polygons(spark, [(k, box(x, y, x + 2, y + 2)) for k, (x, y) in enumerate(corners)])).withColumn("group", F.lit("g"))
    done = ov.dissolved(edges)
    assert done.agg(ov.area().alias("area")).first().area == pytest.approx(len({(x + i, y + j) for x, y in corners for i in (0, 1) for j in (0, 1)}))
    assert first[0][0] == 4 * len(set(corners)) and first[0][1] > 4


def test_repair_of_a_bow_tie(spark):
    edges = ov.ring_edges(polygons(spark, [(1, [(0, 0), (2, 2), (0, 2), (2, 0)]), (2, [(0, 0), (1, 0)]), (3, [(0, 0), (0, 0), (2, 0), (2, 2)])]))
    found = result_rings(ov.repaired(edges), ["id"])
    assert set(found) == {(1,), (3,)}
    assert shoelace(found[1,]) == pytest.approx(2) and all(shoelace([r]) > 0 for r in found[1,]) and len(found[1,]) == 2
    assert shoelace(found[3,]) == pytest.approx(2)
