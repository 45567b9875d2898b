"""Transverse Mercator by series of the third flattening to its sixth power (L. Krueger; C. F. F. Karney, 2011), in columns, with zones by row."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spatial import E2, FLATTENING, A

N = FLATTENING / (2 - FLATTENING)
_E = math.sqrt(E2)
#: Radius of the sphere whose meridian has the ellipsoid's length.
RECTIFYING = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)
SCALE, FALSE_EAST, FALSE_NORTH = 0.9996, 500_000.0, 10_000_000.0
# Coefficients, by power of n from its own index on, from conformal to rectifying latitude, and back.
FORWARD = ((1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800), (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360), (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440), (49561 / 161280, -179 / 168, 6601661 / 7257600), (34729 / 80640, -3418889 / 1995840), (212378941 / 319334400,))
BACK = ((1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800), (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720), (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720), (4397 / 161280, -11 / 504, -830251 / 7257600), (4583 / 161280, -108847 / 3991680), (20648693 / 638668800,))


def _sums(rows: tuple[tuple[float, ...], ...]) -> list[float]:
    return [sum(c * N ** (j + k) for k, c in enumerate(row)) for j, row in enumerate(rows, 1)]


def zone(lon: Column) -> Column:
    """Zone 1 to 60 of six degrees each; 180 is in the first."""
    return (F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1).cast("int")


def central(zone_: Column) -> Column:
    return zone_ * 6.0 - 183.0


def _conformal(t: Column) -> Column:
    """Tangent of the conformal latitude from that of the latitude."""
    s = F.sinh(_E * F.atanh(_E * t / F.sqrt(1 + t * t)))
    return t * F.sqrt(1 + s * s) - s * F.sqrt(1 + t * t)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, not once a mention."""
    return F.transform(F.array(value), use)[0]


def transverse_mercator(lat: Column, lon: Column, zone_: Column | None = None) -> Column:
    """Struct zone, south, x, y in metres; the zone is the longitude's own unless it is given."""

    def lay(g: Column) -> Column:
        x, y = g.eta, g.xi
        for j, a in enumerate(_sums(FORWARD), 1):
            x, y = x + a * F.cos(2 * j * g.xi) * F.sinh(2 * j * g.eta), y + a * F.sin(2 * j * g.xi) * F.cosh(2 * j * g.eta)
        return F.struct(g.zone.alias("zone"), g.south.alias("south"), (SCALE * RECTIFYING * x + FALSE_EAST).alias("x"), (SCALE * RECTIFYING * y + F.when(g.south, FALSE_NORTH).otherwise(0.0)).alias("y"))

    def turn(g: Column) -> Column:
        xi, eta = F.atan2(g.tau, F.cos(g.away)), F.asinh(F.sin(g.away) / F.sqrt(g.tau * g.tau + F.cos(g.away) * F.cos(g.away)))
        return F.struct(g.zone.alias("zone"), g.south.alias("south"), xi.alias("xi"), eta.alias("eta"))

    own = zone(lon) if zone_ is None else zone_
    begin = F.struct(own.alias("zone"), (lat < 0).alias("south"), F.tan(F.radians(lat)).alias("t"), lon.alias("lon"))
    placed = _let(begin, lambda g: F.struct(g.zone.alias("zone"), g.south.alias("south"), _conformal(g.t).alias("tau"), F.radians(F.pmod(g.lon - central(g.zone) + 180, F.lit(360.0)) - 180).alias("away")))
    return _let(_let(placed, turn), lay)


def from_transverse_mercator(zone_: Column, south: Column, x: Column, y: Column, rounds: int = 4) -> Column:
    """Struct lat, lon. The latitude follows from its conformal one by Newton steps, which double its digits."""
    begin = F.struct(zone_.alias("zone"), ((y - F.when(south, FALSE_NORTH).otherwise(0.0)) / (SCALE * RECTIFYING)).alias("xi"), ((x - FALSE_EAST) / (SCALE * RECTIFYING)).alias("eta"))

    def back(g: Column) -> Column:
        p, q = g.xi, g.eta
        for j, b in enumerate(_sums(BACK), 1):
            p, q = p - b * F.sin(2 * j * g.xi) * F.cosh(2 * j * g.eta), q - b * F.cos(2 * j * g.xi) * F.sinh(2 * j * g.eta)
        return F.struct(g.zone.alias("zone"), p.alias("p"), q.alias("q"))

    def place(g: Column) -> Column:
        want = F.sin(g.p) / F.sqrt(F.sinh(g.q) * F.sinh(g.q) + F.cos(g.p) * F.cos(g.p))
        return F.struct(want.alias("want"), (central(g.zone) + F.degrees(F.atan2(F.sinh(g.q), F.cos(g.p)))).alias("lon"))

    def settle(g: Column) -> Column:
        def step(t: Column) -> Column:
            return _let(_conformal(t), lambda have: t + (g.want - have) / F.sqrt(1 + have * have) * (1 + (1 - E2) * t * t) / ((1 - E2) * F.sqrt(1 + t * t)))

        tau = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), g.want / (1 - E2), lambda t, _: step(t))
        return F.struct(F.degrees(F.atan(tau)).alias("lat"), (F.pmod(g.lon + 180, F.lit(360.0)) - 180).alias("lon"))

    return _let(_let(_let(begin, back), place), settle)


def from_web_mercator(x: Column, y: Column) -> Column:
    """Struct lat, lon of spherical Mercator coordinates on the ellipsoid's equator."""
    return F.struct(F.degrees(F.atan(F.sinh(y / A))).alias("lat"), F.degrees(x / A).alias("lon"))
