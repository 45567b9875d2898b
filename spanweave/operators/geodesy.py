"""Geodesics on the WGS-84 ellipsoid: inverse and direct problem, points between, lengths and areas of rings.

A geodesic is a great circle of the auxiliary sphere; its length, its
longitude and the area under it differ from the sphere's by integrals of
smooth functions along it (C. F. F. Karney, Algorithms for geodesics, 2013),
which Gauss-Legendre sums give to rounding here. The azimuth of the inverse
problem is the only root of the longitude it leads to, between 0 and 180
degrees: it is bracketed there for every pair of points, poles and antipodes
included, so nothing falls back to the sphere.

The kernels work on arrays of edges; Spark deals the edges, which are rows,
and sums them by ring. A null or NaN coordinate gives nulls.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import A, E2, FLATTENING

B = A * (1 - FLATTENING)
EP2 = E2 / (1 - E2)
_E = math.sqrt(E2)
#: Square of the radius of the sphere of equal area.
C2 = A * A / 2 + B * B / 2 * math.atanh(_E) / _E
_X, _W = np.polynomial.legendre.leggauss(24)
TINY = 1e-200


def _integral(f: Callable[[np.ndarray], np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    half = (end - start) / 2
    out = np.zeros(np.broadcast(start, end).shape)
    for x, w in zip(_X, _W, strict=True):
        out += w * f(start + half * (1 + x))
    return out * half


def _length(k2: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _integral(lambda s: np.sqrt(1 + k2 * np.sin(s) ** 2), start, end)


def _lag(k2: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """What the longitude stays behind that of the sphere, over f sin(azimuth at the equator)."""
    return _integral(lambda s: (2 - FLATTENING) / (1 + (1 - FLATTENING) * np.sqrt(1 + k2 * np.sin(s) ** 2)), start, end)


def _t(x: np.ndarray) -> np.ndarray:
    root = np.sqrt(x)
    return x + np.sqrt(1 + x) * np.where(root > 0, np.arcsinh(root) / np.where(root > 0, root, 1), 1.0)


def _bulge(k2: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The area under a geodesic beyond the sphere's, over e2 a2 cos sin (azimuth at the equator)."""

    def f(s: np.ndarray) -> np.ndarray:
        x = np.minimum(k2 * np.sin(s) ** 2, EP2)
        gap = EP2 - x
        near = gap < 1e-7
        # The slope of t, by a central step, where the two ends meet.
        slope = (_t(np.full_like(x, EP2 + 1e-6)) - _t(np.full_like(x, EP2 - 1e-6))) / 2e-6
        return np.where(near, slope, (_t(np.full_like(x, EP2)) - _t(x)) / np.where(near, 1, gap)) * np.sin(s) / 2

    return -_integral(f, start, end)


def _reduced(lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sine and cosine of the reduced latitude; the cosine at a pole is tiny, not 0."""
    p = np.radians(lat)
    s, c = (1 - FLATTENING) * np.sin(p), np.where(np.abs(lat) == 90, 0.0, np.cos(p))
    r = np.hypot(s, c)
    return s / r, np.maximum(c / r, TINY)


def _path(salp1: np.ndarray, calp1: np.ndarray, sb1: np.ndarray, cb1: np.ndarray, sb2: np.ndarray, cb2: np.ndarray) -> tuple[np.ndarray, ...]:
    """From an azimuth to the first time that the geodesic reaches latitude 2 going north: azimuth there, arcs, spherical longitude."""
    salp0 = salp1 * cb1
    calp0 = np.hypot(calp1, salp1 * sb1)
    salp2 = salp0 / cb2
    gain = np.where(cb1 < -sb1, (cb2 - cb1) * (cb1 + cb2), (sb1 - sb2) * (sb1 + sb2))
    calp2 = np.where((cb2 != cb1) | (np.abs(sb2) != -sb1), np.sqrt(np.maximum(0, (calp1 * cb1) ** 2 + gain)) / cb2, np.abs(calp1))
    s1, s2 = np.arctan2(sb1, calp1 * cb1), np.arctan2(sb2, calp2 * cb2)
    s2 = np.where(s2 < s1, s1, s2)
    omega = np.arctan2(salp0 * sb2, calp2 * cb2) - np.arctan2(salp0 * sb1, calp1 * cb1)
    return salp2, calp2, salp0, calp0, s1, s2, np.mod(omega, 2 * np.pi)


def inverse(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Metres, azimuths at both ends (degrees, -180 to 180), and the area between the geodesic and the equator."""
    lat1, lon1, lat2, lon2 = (np.array(x, float) for x in np.broadcast_arrays(lat1, lon1, lat2, lon2))
    turn = np.mod(lon2 - lon1, 360.0)
    turn = np.where(turn > 180, turn - 360, turn)
    east = np.where(turn < 0, -1.0, 1.0)
    lam = np.radians(np.abs(turn))
    # Point 1 is the farther one from the equator, and south of it.
    swap = np.abs(lat1) < np.abs(lat2)
    far, near = np.where(swap, lat2, lat1), np.where(swap, lat1, lat2)
    south = np.where(far > 0, -1.0, 1.0)
    sb1, cb1 = _reduced(far * south)
    sb2, cb2 = _reduced(near * south)
    sb1 = np.where(sb1 == 0, -TINY, sb1)
    same = np.abs(lat1) == np.abs(lat2)
    cb2, sb2 = np.where(same, cb1, cb2), np.where(same, np.sign(near * south) * np.abs(sb1), sb2)

    def off(salp: np.ndarray, calp: np.ndarray) -> np.ndarray:
        _, _, salp0, calp0, s1, s2, omega = _path(salp, calp, sb1, cb1, sb2, cb2)
        return omega - FLATTENING * salp0 * _lag(EP2 * calp0**2, s1, s2) - lam

    # About 90 degrees the azimuth is told by what it lacks, as near the equator its cosine must be known to all digits.
    half, quarter = np.full(lam.shape, np.sqrt(0.5)), np.pi / 4
    low, high = off(half, half), off(half, -half)
    across = (low < 0) & (high > 0)
    sides = lambda x: (np.where(across, np.cos(x), np.sin(x)), np.where(across, -np.sin(x), np.cos(x)))
    ends = [np.where(across, a, b) for a, b in ((quarter, np.pi), (high, np.pi - lam), (-quarter, 0.0), (low, -lam))]
    alp = _root(lambda x: off(*sides(x)), *ends, np.where(across, 1e-20, 1.0))
    equator = (far == 0) & (lam <= (1 - FLATTENING) * np.pi)
    salp1, calp1 = sides(alp)
    straight, over = lam == 0, lam == np.pi
    pole = np.abs(far) == 90
    salp1 = np.where(straight & ~pole, 0.0, np.where(over & ~pole & (far != 0), np.where(np.abs(lat1 + lat2) > 0, 0.0, salp1), salp1))
    calp1 = np.where(straight & ~pole, 1.0, np.where(over & ~pole & (far != 0) & (np.abs(lat1 + lat2) > 0), -1.0, calp1))
    # Seen from a pole, the azimuth is the longitude; from its own meridian, north or south.
    salp1, calp1 = np.where(pole, np.sin(lam), salp1), np.where(pole, np.cos(lam), calp1)
    salp2, calp2, salp0, calp0, s1, s2, _ = _path(salp1, calp1, sb1, cb1, sb2, cb2)
    k2 = EP2 * calp0**2
    metres = np.where(equator, A * lam, B * _length(k2, s1, s2))
    salp1, calp1 = np.where(equator, 1.0, salp1), np.where(equator, 0.0, calp1)
    salp2, calp2 = np.where(equator, 1.0, salp2), np.where(equator, 0.0, calp2)
    beside = np.arctan2(salp2 * calp1 - calp2 * salp1, calp2 * calp1 + salp2 * salp1)
    area = np.where(equator, 0.0, C2 * beside + E2 * A * A * calp0 * salp0 * _bulge(k2, s1, s2))
    area = np.where(equator, 0.0, area) * east * south
    # Back to the given order: a swap turns the path round, a mirror changes north and south.
    a1, c1 = np.where(swap, salp2, salp1), np.where(swap, calp2, calp1)
    a2, c2 = np.where(swap, salp1, salp2), np.where(swap, calp1, calp2)
    flip = np.where(swap, -1.0, 1.0) * south
    az1, az2 = np.degrees(np.arctan2(a1 * east, c1 * flip)), np.degrees(np.arctan2(a2 * east, c2 * flip))
    nothing = (lat1 == lat2) & ((turn == 0) | (np.abs(lat1) == 90))
    return np.where(nothing, 0.0, metres), az1, az2, np.where(nothing, 0.0, area)


def _root(f: Callable[[np.ndarray], np.ndarray], a: np.ndarray, fa: np.ndarray, b: np.ndarray, fb: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """The root of f between b and a, where it is fb and fa, below and above 0, to the digits of unit + |root|: steps by inverse quadratics within a bracket, else halves."""
    c, fc, t = a.copy(), fa.copy(), np.full(a.shape, 0.5)
    for _ in range(100):
        x = a + t * (b - a)
        fx = f(x)
        kept = np.sign(fx) == np.sign(fa)
        c, fc = np.where(kept, a, b), np.where(kept, fa, fb)
        b, fb = np.where(kept, b, a), np.where(kept, fb, fa)
        a, fa = x, fx
        best = np.where(np.abs(fa) < np.abs(fb), a, b)
        wide = np.abs(b - a)
        if (np.isnan(fx) | (fx == 0) | (wide < 4e-16 * (unit + np.abs(best)))).all():
            break
        with np.errstate(all="ignore"):
            xi, phi = (a - b) / (c - b), (fa - fb) / (fc - fb)
            quadratic = (phi**2 < xi) & ((1 - phi) ** 2 < 1 - xi)
            step = fa / (fb - fa) * fc / (fb - fc) + (c - a) / (b - a) * fa / (fc - fa) * fb / (fc - fb)
            least = np.minimum(0.5, 2e-16 * (unit + np.abs(best)) / wide)
        t = np.clip(np.where(quadratic & np.isfinite(step), step, 0.5), least, 1 - least)
    return np.where(np.abs(fa) < np.abs(fb), a, b)


def direct(lat: np.ndarray, lon: np.ndarray, azimuth: np.ndarray, metres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Latitude, longitude and azimuth at the end of a geodesic, of any length, backwards if it is negative."""
    lat, lon, azimuth, metres = (np.array(x, float) for x in np.broadcast_arrays(lat, lon, azimuth, metres))
    sb1, cb1 = _reduced(lat)
    azimuth = np.mod(azimuth + 180, 360.0) - 180
    right = np.abs(azimuth) == 90
    salp1, calp1 = np.where(np.abs(azimuth) == 180, 0.0, np.sin(np.radians(azimuth))), np.where(right, 0.0, np.cos(np.radians(azimuth)))
    salp0, calp0 = salp1 * cb1, np.hypot(calp1, salp1 * sb1)
    k2 = EP2 * calp0**2
    s1 = np.where((sb1 == 0) & (calp1 == 0), 0.0, np.arctan2(sb1, calp1 * cb1))
    zero, full = np.zeros(lat.shape), np.full(lat.shape, 2 * np.pi)
    round_, lag_round = _length(k2, zero, full), _lag(k2, zero, full)
    turns = np.trunc(metres / B / round_)
    rest = metres / B - turns * round_
    s2 = s1 + rest * 2 * np.pi / round_
    for _ in range(8):
        step = (rest - _length(k2, s1, s2)) / np.sqrt(1 + k2 * np.sin(s2) ** 2)
        s2 = s2 + step
        if (np.isnan(step) | (np.abs(step) < 1e-15)).all():
            break
    ss2, cs2 = np.sin(s2), np.cos(s2)
    sb2, cb2 = calp0 * ss2, np.hypot(salp0, calp0 * cs2)
    omega = lambda s: np.arctan2(salp0 * np.sin(s), np.cos(s)) + np.sign(salp0) * 2 * np.pi * np.round(s / (2 * np.pi))
    # The start in its own sine and cosine, which at a pole tell the longitude still.
    swept = omega(s2) - np.arctan2(salp0 * sb1, np.where((sb1 == 0) & (calp1 == 0), 1.0, calp1 * cb1)) + np.where(salp0 < 0, -1.0, 1.0) * 2 * np.pi * turns
    over = swept - FLATTENING * salp0 * (_lag(k2, s1, s2) + turns * lag_round)
    end = np.mod(lon + np.degrees(over) + 180, 360.0) - 180
    return np.degrees(np.arctan2(sb2, (1 - FLATTENING) * cb2)), end, np.degrees(np.arctan2(salp0, calp0 * cs2))


def _struct(names: str, kernel: Callable) -> Callable:
    @F.pandas_udf(", ".join(f"{n} double" for n in names.split()))
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        with np.errstate(all="ignore"):
            return pd.DataFrame(dict(zip(names.split(), kernel(*(x.to_numpy(float, na_value=np.nan) for x in (a, b, c, d))), strict=True))).replace({np.nan: None}).astype(float)

    return run


def inverse_of(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Struct metres, azimuth1, azimuth2, under (area between the geodesic and the equator, m2)."""
    return _struct("metres azimuth1 azimuth2 under", inverse)(*(x.cast("double") for x in (lat1, lon1, lat2, lon2)))


def direct_of(lat: Column, lon: Column, azimuth: Column, metres: Column) -> Column:
    """Struct lat, lon, azimuth."""
    return _struct("lat lon azimuth", direct)(*(x.cast("double") for x in (lat, lon, azimuth, metres)))


def _between(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    metres, azimuth, _, _ = inverse(lat1, lon1, lat2, lon2)
    lat, lon, _ = direct(lat1, lon1, azimuth, metres * part)
    return np.where(part == 0, lat1, np.where(part == 1, lat2, lat)), np.where(part == 0, lon1, np.where(part == 1, lon2, lon))


def between(lat1: Column, lon1: Column, lat2: Column, lon2: Column, part: Column) -> Column:
    """Struct lat, lon of the point a part, 0 to 1, of the way; a half is the midpoint; null for other parts."""

    @F.pandas_udf("lat double, lon double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, p: pd.Series) -> pd.DataFrame:
        with np.errstate(all="ignore"):
            lat, lon = _between(*(x.to_numpy(float, na_value=np.nan) for x in (a, b, c, d, p)))
        return pd.DataFrame({"lat": lat, "lon": lon})

    return F.when(part.between(0, 1), run(*(x.cast("double") for x in (lat1, lon1, lat2, lon2, part))))


def ring_measures(rings: DataFrame, *keys: str) -> DataFrame:
    """keys, signed area_m2 (positive counter-clockwise) and perimeter_m of rings (keys, ring: array of (lat, lon)).

    Every edge is a row; a ring around a pole counts the turns that its edges
    make. Fewer than three corners have area 0.
    """
    after = F.concat(F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1))
    steps = F.zip_with("ring", after, lambda a, b: F.struct(a.lat.alias("lat1"), a.lon.alias("lon1"), b.lat.alias("lat2"), b.lon.alias("lon2")))
    edges = rings.where(F.size("ring") > 0).select(*keys, F.inline(steps))
    turn = F.pmod(F.col("lon2") - F.col("lon1") + 180, F.lit(360.0)) - 180
    turn = F.when(turn == -180, 180.0).otherwise(turn)
    told = edges.select(*keys, turn.alias("turn"), inverse_of(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).alias("g"))
    sums = told.groupBy(*keys).agg(F.sum("g.under").alias("under"), F.sum("g.metres").alias("perimeter_m"), F.sum("turn").alias("turn"), F.count("*").alias("n"))
    area = F.round(F.col("turn") / 360) * 2 * math.pi * C2 - F.col("under")
    return sums.select(*keys, F.when(F.col("n") < 3, 0.0).otherwise(area).alias("area_m2"), "perimeter_m")


def polygon_measures(rings: DataFrame) -> DataFrame:
    """id, area_m2 and perimeter_m of polygons (id, part, ring): part 0 is the outer ring, the others are holes.

    The area is the outer ring's less the holes', all without sign; it is null
    where the holes are larger. The perimeter is the outer ring's.
    """
    per = ring_measures(rings, "id", "part")
    size = F.abs("area_m2")
    told = per.groupBy("id").agg(F.sum(F.when(F.col("part") == 0, size).otherwise(-size)).alias("area"), F.sum(F.when(F.col("part") == 0, F.col("perimeter_m"))).alias("perimeter_m"))
    return told.select("id", F.when(F.col("area") >= 0, F.col("area")).alias("area_m2"), "perimeter_m")
