"""Partners of boxes against all pairs."""

import random

import pytest

from spanweave.operators import tiles as ti
from spanweave.queries import geometry

BOXES = "id long, label long, w double, s double, e double, n double"


def told(boxes):
    meet = lambda a, b: a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]
    out = {}
    whole = [b for b in boxes if None not in b]
    for a in whole:
        near = [b[0] for b in whole if a[1] != b[1] and meet(a, b)]
        if near:
            out[a[0]] = (len(near), min(near))
    return out


@pytest.mark.parametrize(("seed", "span"), [(1, 6), (2, 60)])
def test_partners_are_those_of_all_pairs(spark, seed, span):
    draw, boxes = random.Random(seed), []
    for i in range(150):
        w, s = draw.randrange(span), draw.randrange(span)
        boxes.append((i, draw.randrange(3), float(w), float(s), float(w + draw.randrange(3)), float(s + draw.randrange(3))))
    boxes += [(200, None, 0.0, 0.0, 9.0, 9.0), (201, 1, None, 0.0, 9.0, 9.0)]
    for strip in (20, 10**6):
        got = {r.id: (r.n, r["first"]) for r in ti.partners(spark.createDataFrame(boxes, BOXES), "label", strip=strip, few=10).collect()}
        assert got == told(boxes)
    assert ti.partners(spark.createDataFrame([], BOXES), "label").collect() == []


def test_box_join_makes_no_pairs_of_all(spark, monkeypatch):
    """2,000 kites that all meet: the pairs looked at are bounded by rows, not by their square."""
    made, join = [], ti.join_boxes
    monkeypatch.setattr(ti, "join_boxes", lambda *a, **k: (lambda d: (made.append(d.count()), d)[1])(join(*a, **k)))
    rows = [(i, i % 2, 1.0, 1.0) for i in range(2000)]
    monkeypatch.setattr(geometry.v, "points", lambda s, d: s.createDataFrame(rows, "id long, label long, lat double, lon double"))
    monkeypatch.setattr(ti.partners, "__defaults__", (ti.STRIP_ROWS, 20))
    got = {r.id: (r.n, r["first"]) for r in geometry.sp12_box_join(spark, "").collect()}
    assert got == {i: (1000, 1 - i % 2) for i in range(2000)}
    assert sum(made) <= 20 * 2000
