"""Known values of cells, canonical JSON, projections, Sobol points and money."""

import itertools
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spanweave.operators import canonical as ca
from spanweave.operators import cells as ce
from spanweave.operators import money as mo
from spanweave.operators import projections as pr
from spanweave.operators import sampling as sa


def test_cells_are_those_of_the_public_scheme(spark):
    known = [(0x47A1CBD595522B39, 49.703498679, 11.770681595), (0x46525318B63BE0F9, 55.685376759, 12.588490937), (0x52B30B71698E729D, 45.486546517, -93.449700022), (0x46ED8886CFADDA85, 58.299984854, 23.049300056), (0x3663F18A24CBE857, 34.364439040, 108.330699969), (0x010A06C0A948CF5D, -30.694551352, -30.048758753)]
    df = spark.createDataFrame([(f"{c:016x}", a, o) for c, a, o in known] + [(None, None, 1.0), (None, float("nan"), 1.0)], "token string, lat double, lon double")
    rows = ce.cells(df).select("token", ce.token(ce.parent(F.col("cell"), 20)).alias("t"), "cell").collect()
    for r in rows:
        # Points are given to nine digits, a ten thousandth of a metre: cells of level 20 are seven metres wide.
        assert (r.t is None) if r.token is None else r.token.startswith(r.t[:-1])
    assert sum(r.cell is None for r in rows) == 2


def test_cells_nest(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 181 - 90.0).alias("lat"), ((F.col("id") * 101) % 361 - 180.0).alias("lon"))
    rows = ce.cells(df)
    for level in (0, 3, 17, 29):
        low, high = ce.span(ce.parent(F.col("cell"), level))
        again = ce.parent(ce.parent(F.col("cell"), level + 1), level)
        assert rows.where(~F.col("cell").between(low, high) | (again != ce.parent(F.col("cell"), level))).count() == 0


@pytest.mark.parametrize(("given", "want"), [
    ('{"\\u20ac":"Euro Sign","\\r":"Carriage Return","\\ufb33":"Hebrew Letter Dalet With Dagesh","1":"One","\\ud83d\\ude00":"Emoji: Grinning Face","\\u0080":"Control","\\u00f6":"Latin Small Letter O With Diaeresis"}', '{"\\r":"Carriage Return","1":"One","\x80":"Control","ö":"Latin Small Letter O With Diaeresis","€":"Euro Sign","😀":"Emoji: Grinning Face","דּ":"Hebrew Letter Dalet With Dagesh"}'),
    ('[333333333.33333329,1E30,4.50,2e-3,0.000000000000000000000000001,-0,1e21,123456789012345680000]', "[333333333.3333333,1e+30,4.5,0.002,1e-27,0,1e+21,123456789012345680000]"),
    (' { "b" : [ ] , "a" : { "y":true,"x":null } }', '{"a":{"x":null,"y":true},"b":[]}'), ('"\\u000f\\n\\"\\\\\\/"', '"\\u000f\\n\\"\\\\/"'),
    ('{"a":1,"a":2}', None), ("[1,]", None), ("NaN", None), ("1e999", None), ('"\\ud800"', None), (None, None), ("", None),
])
def test_canonical_json(given, want):
    assert ca.canonical_text(given) == want


def test_transverse_mercator_at_zone_borders(spark):
    rows = [(lat, lon) for lat in (-84.0, -30.0, 0.0, 0.5, 45.0, 84.0) for lon in (-180.0, -174.000001, -174.0, -3.0, 0.0, 5.999999, 6.0, 179.9, 180.0)]
    df = spark.createDataFrame(rows, "lat double, lon double").withColumn("t", pr.transverse_mercator(F.col("lat"), F.col("lon")))
    got = df.withColumn("b", pr.from_transverse_mercator(F.col("t.zone"), F.col("t.south"), F.col("t.x"), F.col("t.y"))).collect()
    for r in got:
        assert r.b.lat == pytest.approx(r.lat, abs=1e-10) and (r.b.lon - r.lon + 180) % 360 - 180 == pytest.approx(0, abs=1e-8)
    by = {(r.lat, r.lon): r.t for r in got}
    assert [by[0.0, x].zone for x in (-180.0, -174.000001, -174.0, -3.0, 0.0, 5.999999, 6.0, 179.9, 180.0)] == [1, 1, 2, 30, 31, 31, 32, 60, 1]
    assert by[0.0, -3.0].x == pytest.approx(500_000) and by[45.0, -3.0].y == pytest.approx(4_982_950.4, abs=0.1)


def test_elementary_intervals_of_sobol_points(spark):
    rows = spark.range(1024).select(*[sa.sobol(F.col("id"), k).alias(f"x{k}") for k in range(8)]).collect()
    for k in range(8):
        assert Counter(int(r[k] * 1024) for r in rows) == dict.fromkeys(range(1024), 1)
    for a, b in ((32, 32), (4, 256), (256, 4), (2, 512)):
        assert Counter((int(r[0] * a), int(r[1] * b)) for r in rows) == {c: 1 for c in itertools.product(range(a), range(b))}
    assert [r.x for r in spark.range(-1, 3).select(sa.sobol(F.col("id"), 1).alias("x")).collect()] == [None, 0.0, 0.5, 0.25]


def test_money_takes_spread_and_fee_on_each_leg(spark):
    rates = spark.createDataFrame([("USD", "EUR", Decimal("0.9"), 100, 50), ("GBP", "USD", Decimal("1.25"), 0, 0), ("EUR", "CHF", Decimal("1.1"), 20, 0), ("EUR", "USD", Decimal("1.2"), 0, 0), ("EUR", "EUR", Decimal("2"), 0, 0), ("USD", "XXX", Decimal("0"), 0, 0)], "base string, quote string, rate decimal(10,4), spread_bps int, fee_bps int")
    amounts = spark.createDataFrame([(1, "GBP", "CHF", Decimal("100.00")), (2, "USD", "GBP", Decimal("10.00")), (3, "USD", "USD", Decimal("1.005")), (4, "USD", "XXX", Decimal("1")), (5, None, "USD", Decimal("1")), (6, "USD", "EUR", None), (7, "EUR", "USD", Decimal("1"))], "id int, source string, target string, amount decimal(12,3)")
    got = {r.id: r for r in mo.convert(amounts, rates).collect()}
    want = Decimal("100") * Decimal("1.25") * Decimal("0.9") * Decimal("0.995") * Decimal("0.995") * Decimal("1.1") * Decimal("0.999")
    assert got[1].path == ["GBP", "USD", "EUR", "CHF"] and got[1].converted == want.quantize(Decimal("0.01")) and [x.inverted for x in got[1].legs] == [False] * 3
    assert got[2].converted == Decimal("8.00") and got[2].legs[0].inverted and got[3].converted == Decimal("1.00") and got[7].converted == Decimal("1.20")
    assert all(got[k].converted is None for k in (4, 5, 6)) and len(got) == 7
