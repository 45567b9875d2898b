"""Scalar rules against Python's own: rounding, timestamps, units, guards, rings, settings."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from spanweave.functions import scalars as sc
from spanweave.operators import propagation as p
from spanweave.operators import spatial as sp
from spanweave.operators import stats as st
from spanweave.operators import evidence as ev

MODES = {m: getattr(decimal, "ROUND_" + m.upper()) for m in sc.ROUNDINGS}


def test_quantize_like_decimal(spark):
    xs = [decimal.Decimal(x) for x in "0 0.005 -0.005 1.015 1.025 -1.025 2.345 2.3451 -2.3449 7.501 7.55 -0.001 0.1 -3.999".split()]
    df = spark.createDataFrame([(x,) for x in xs], "x decimal(18,6)")
    for mode, how in MODES.items():
        got = [(r.x, r.y) for r in df.select("x", sc.quantize(F.col("x"), 2, mode).alias("y")).collect()]
        assert got == [(x, x.quantize(decimal.Decimal("0.01"), how)) for x in xs], mode


def test_rfc3339(spark):
    good = {"2024-02-29T23:59:59Z": "2024-02-29 23:59:59", "2024-01-01t00:00:00.1234567+05:30": "2023-12-31 18:30:00.123456", " 2024-01-01 00:00:00-00:30 ": "2024-01-01 00:30:00"}
    bad = ["", "2024-01-01", "2024-01-01T00:00:00", "2024-13-01T00:00:00Z", "2023-02-29T00:00:00Z", "2024-01-01T00:00:00+24:00", "2024-01-01T00:00:00+01:60", "2024-01-01T00:00:00+0100", "x2024-01-01T00:00:00Z", "2024-01-01T25:00:00Z", None]
    rows = {r.t: r.at for r in spark.createDataFrame([(t,) for t in [*good, *bad]], "t string").select("t", sc.parse_rfc3339(F.col("t")).alias("at")).collect()}
    assert {t: rows[t] for t in good} == {t: datetime.datetime.fromisoformat(x) for t, x in good.items()}
    assert all(rows[t] is None for t in bad)


def test_units(spark):
    df = spark.createDataFrame([(x,) for x in ("kg*m/s^2", "N", "kWh / h", "m^-2", "1", "", "q", "m//s", "(m)", None)], "x string")
    got = {r.x: (r.u.scale, r.u.dimension) if r.u else None for r in df.select("x", sc.parse_units(F.col("x")).alias("u")).collect()}
    assert got["kg*m/s^2"] == got["N"] == (1.0, "1,1,-2,0,0,0")
    assert got["kWh / h"] == (1000.0, "2,1,-3,0,0,0") and got["m^-2"] == (1.0, "-2,0,0,0,0,0") and got["1"] == (1.0, "0,0,0,0,0,0")
    assert [got[x] for x in ("", "q", "m//s", "(m)", None)] == [None] * 5


def test_guards(spark):
    df = spark.createDataFrame([(x, op) for x in (1.0, None) for op in ("eq", "ne", "lt", "le", "ge", "gt")], "x double, op string")
    got = {(r.x, r.op): r.h for r in df.select("x", "op", sc.guard_holds(F.col("x"), F.col("op"), F.lit(1.0)).alias("h")).collect()}
    assert [op for (x, op), h in got.items() if x == 1.0 and h] == ["eq", "le", "ge"]
    assert [op for (x, op), h in got.items() if x is None and h] == ["ne"]
    with pytest.raises(Exception, match="no such comparison"):
        df.select(sc.guard_holds(F.col("x"), F.lit("like"), F.lit(1.0))).collect()


def test_inverse_twice_is_the_same():
    assert len(sc.INVERSES) == 13 and all(sc.INVERSES[y] == x for x, y in sc.INVERSES.items())


def test_violations_names_every_broken_rule(spark):
    df = spark.createDataFrame([(1, "a"), (-1, None), (None, "b")], "n int, t string")
    got = [r[0] for r in df.select(sc.violations({"n": F.col("n") > 0, "t": F.col("t").isNotNull()})).collect()]
    assert got == ["", "n,t", "n"]


def test_rings(spark):
    square, arrow = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)], [(0.0, 0.0), (10.0, 20.0), (0.0, 10.0), (-10.0, 20.0)]
    polygons = spark.createDataFrame([("square", square), ("arrow", arrow), ("line", square[:2]), ("empty", [])], "poly string, ring array<struct<lat:double,lon:double>>")
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 5.0, 15.0), (3, 0.5, 9.0), (4, 0.0, 15.0), (5, None, 1.0), (6, 50.0, 50.0)], "id int, lat double, lon double")
    got = {(r.poly, r.id) for r in sp.in_polygons(points, polygons, 7.0).collect()}
    assert got == {("square", 1), ("square", 3), ("arrow", 3)}


def test_features(spark):
    df = spark.createDataFrame([(1, 1.23456789, -2.5), (2, None, 1.0)], "id int, lat double, lon double")
    text = df.select(sp.point_feature(F.col("id"), F.col("lat"), F.col("lon"), F.struct("id")).alias("t"))
    first, second = [r.t for r in text.collect()]
    assert first == '{"type":"Feature","id":"1","geometry":{"type":"Point","coordinates":[-2.5,1.234568]},"properties":{"id":1}}'
    assert '"geometry":null' in second
    back = [r[0] for r in text.union(spark.createDataFrame([("{",), ('{"type":"Point"}',), (None,)], "t string")).select(sp.parse_points(F.col("t"))).collect()]
    assert tuple(back[0]) == ("1", 1.234568, -2.5) and back[1:] == [None] * 4


def test_rules_refuse_and_name():
    assert p.Rules().digest() == p.Rules().digest() != p.Rules(hops=3).digest()
    assert p.Rules(kinds=("a",)).mapping()["kinds"] == ["a"]
    for wrong in ({"least": 0.0}, {"least": 2.0}, {"hops": -1}, {"delay_seconds": -1.0}, {"least_factor": 1.5}, {"least": float("nan")}, {"aggregation": "sum"}):
        with pytest.raises(ValueError):
            p.Rules(**wrong).check()


def test_outcome_of_nothing(spark):
    none = spark.createDataFrame([], "shock_id string, entity string, depth int, impairment double")
    assert tuple(p.outcome(none).first()) == ("no_initial_signal", 0, 0, 0, 0, 0.0)


def test_state_digest_ignores_order(spark):
    rows = [("w", "a", 0.5), ("w", "b", 1.0), ("x", "b", 1.0), ("x", "a", 0.5), ("y", "a", 0.5), ("y", "b", 0.9)]
    got = {r.w: r.digest for r in p.state_digest(spark.createDataFrame(rows, "w string, entity string, capacity double"), ["w"]).collect()}
    assert got["w"] == got["x"] != got["y"]


def test_fuse(spark):
    rows = [("s", "a", 1.0, 1.0, 1), ("s", "a", 2.0, 0.5, 1), ("s", "b", 3.0, 0.6, 2), ("t", "a", None, 0.4, None)]
    got = {r.s: (r.attributes, r.conflict, round(r.confidence, 9), r.evidence) for r in st.fuse(spark.createDataFrame(rows, "s string, attribute string, value double, confidence double, evidence_id int"), "s").collect()}
    assert got == {"s": (2, 0.5, round(0.7 * 0.75, 9), 2), "t": (1, 0.0, 0.4, 0)}


def test_fuse_adds_in_order(spark):
    """Large and small numbers add up to another sum in another order; a count of distinct evidence regroups a plain mean."""
    given = [(k, f"s{k % 3}", (1e16, 0.3, -1e16, 0.7)[k % 4] if k % 11 else None, k % 5) for k in range(120)] + [(500, "none", None, None)]
    rows = spark.createDataFrame([given[k * 37 % len(given)] for k in range(len(given))], "k long, s string, confidence double, evidence_id int").repartition(7).selectExpr("*", "'a' AS attribute", "1.0 AS value")
    got = {r.s: (r.confidence, r.evidence) for r in st.fuse(rows, "s", "k").collect()}
    for s in ("s0", "s1", "s2"):
        total, n = 0.0, 0
        for _, _, c, _ in (r for r in given if r[1] == s and r[2] is not None):
            total, n = total + c, n + 1
        assert got[s] == (total / n, 5)
    assert got["none"] == (None, 0)


def test_credentials(spark):
    df = spark.createDataFrame([(1, "x\nAPI-key: 1\npasswords = y\nsecret=z " + "w" * 300), (2, None), (3, "")], "doc_id int, text string")
    got = [(r.doc_id, r.line, r.redacted) for r in ev.credential_lines(df).collect()]
    assert got == [(1, 2, "API-key=<redacted>"), (1, 4, "secret=<redacted>")]


def test_by_entity(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (None, "x")], "n long, t string")
    about = {"number": "n", "name": "t"}
    found = lambda e: [tuple(r) for r in ev.by_entity(df, about, e).collect()]
    assert found("number:2") == [(2, "y")] and found("name:x") == [(1, "x"), (None, "x")]
    assert found("number:q") == found("other:1") == found("number") == []
