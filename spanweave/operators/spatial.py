"""WGS-84 and spherical geometry on longitude and latitude columns, grid joins, boxes that may cross the antimeridian."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Mean earth radius in km; the WGS-84 ellipsoid.
RADIUS_KM = 6371.0088
A, FLATTENING = 6378137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)


def central_angle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * F.asin(F.when(h > 1, 1.0).otherwise(F.sqrt(h)))  # null where a coordinate is


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return RADIUS_KM * central_angle(lat1, lon1, lat2, lon2)


def in_box(lat: Column, lon: Column, west: float, south: float, east: float, north: float) -> Column:
    """Inclusive; a box with west > east crosses the antimeridian."""
    inside = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(south, north) & inside


def normalize_longitude(lon: Column) -> Column:
    """Into [-180, 180]; positive odd multiples of 180 stay 180."""
    r = F.pmod(lon + 180, F.lit(360.0)) - 180
    return F.when((r == -180) & (lon > 0), F.lit(180.0)).otherwise(r)


def ecef(lat: Column, lon: Column, height: Column) -> tuple[Column, Column, Column]:
    p, q = F.radians(lat), F.radians(lon)
    n = A / F.sqrt(1 - E2 * F.pow(F.sin(p), 2))
    return (n + height) * F.cos(p) * F.cos(q), (n + height) * F.cos(p) * F.sin(q), (n * (1 - E2) + height) * F.sin(p)


def from_ecef(x: Column, y: Column, z: Column, rounds: int = 4) -> tuple[Column, Column, Column]:
    """Latitude, longitude and height; the latitude by fixed-point rounds, which gain two digits each."""
    p = F.sqrt(x * x + y * y)
    lat = F.atan2(z, p * (1 - E2))
    for _ in range(rounds):
        n = A / F.sqrt(1 - E2 * F.pow(F.sin(lat), 2))
        lat = F.atan2(z + E2 * n * F.sin(lat), p)
    n = A / F.sqrt(1 - E2 * F.pow(F.sin(lat), 2))
    # Near a pole by the axis, else by the equator: each loses no digits there.
    height = F.when(F.abs(lat) > math.pi / 4, F.abs(z) / F.abs(F.sin(lat)) - n * (1 - E2)).otherwise(p / F.cos(lat) - n)
    return F.degrees(lat), F.degrees(F.atan2(y, x)), height


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing on the sphere, degrees from north, 0 to 360."""
    p, q, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east, north = F.sin(dl) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360, F.lit(360.0))


def destination(lat: Column, lon: Column, bearing_deg: Column, km: Column) -> tuple[Column, Column]:
    """The point that lies ``km`` from a point on a bearing, on the sphere."""
    p, b, d = F.radians(lat), F.radians(bearing_deg), km / RADIUS_KM
    to = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    dl = F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(to))
    return F.degrees(to), normalize_longitude(lon + F.degrees(dl))


def cells(df: DataFrame, size: float, prefix: str = "") -> DataFrame:
    return df.withColumns({f"{prefix}cx": F.floor((F.col(f"{prefix}lon") + 180) / size), f"{prefix}cy": F.floor((F.col(f"{prefix}lat") + 90) / size)})


def within_km(left: DataFrame, right: DataFrame, km: float, size: float = 5.0) -> DataFrame:
    """Pairs (l_*, r_*) of points (id, lat, lon) at most ``km`` apart, by a join on grid cells.

    Each left point looks into all cells its circle can touch; near the poles
    that is every cell of a row. The cells wrap at the antimeridian.
    """
    across, along = int(round(360 / size)), math.degrees(km / RADIUS_KM)
    a = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns])
    b = cells(right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]), size, "r_")
    top = F.least(F.lit(90.0), F.abs("l_lat") + along)
    spread = F.when(top >= 90 - 1e-9, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(km / RADIUS_KM)) / F.cos(F.radians(F.col("l_lat")))))) + 1e-9)
    wide = F.coalesce(F.when(F.isnan(spread), F.lit(180.0)).otherwise(spread), F.lit(180.0))
    lo, hi = F.floor((F.col("l_lon") - wide + 180) / size), F.floor((F.col("l_lon") + wide + 180) / size)
    xs = F.when(hi - lo >= across - 1, F.sequence(F.lit(0), F.lit(across))).otherwise(F.array_distinct(F.flatten(F.transform(F.sequence(lo, hi), lambda x: F.when(F.pmod(x, F.lit(across)) == 0, F.array(F.lit(0).cast("long"), F.lit(across).cast("long"))).otherwise(F.array(F.pmod(x, F.lit(across))))))))
    ys = F.sequence(F.floor((F.col("l_lat") - along + 90) / size), F.floor((F.col("l_lat") + along + 90) / size))
    dealt = a.withColumn("r_cx", F.explode(xs)).withColumn("r_cy", F.explode(ys))
    d = haversine_km(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))
    return dealt.join(b, ["r_cx", "r_cy"]).withColumn("km", d).where(F.col("km") <= km).drop("r_cx", "r_cy").dropDuplicates(["l_id", "r_id"])


def nearest(targets: DataFrame, points: DataFrame, k: int, start_km: float = 500.0, size: float = 5.0) -> DataFrame:
    """The k nearest points (id, km, place) of each target t (id, lat, lon), not counting itself; ids break ties.

    Rounds of growing radius: a target that has k points within the radius is
    done, as no other can be nearer; the rest looks three times as far.
    """
    from pyspark.sql import Window

    from ..plans.lineage import cut

    rest, out, km = cut(targets.select("id", "lat", "lon")), None, start_km
    w = Window.partitionBy("l_id").orderBy("km", "r_id")
    while True:
        last = km >= 1000 * math.pi * 6.4
        found = within_km(rest, points.select("id", "lat", "lon"), km, size if km < 2000 else 30.0).where("l_id <> r_id")
        ranked = cut(found.withColumn("km", F.round("km", 6)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k))
        done = ranked if last else ranked.join(ranked.where(F.col("place") == k).select("l_id"), "l_id", "left_semi")
        done = done.select(F.col("l_id").alias("t"), F.col("r_id").alias("id"), "km", F.col("place").cast("long").alias("place"))
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        rest = cut(rest.join(done.select(F.col("t").alias("id")).distinct(), "id", "left_anti"))
        if rest.isEmpty():
            return out
        km *= 3


def in_boxes(points: DataFrame, boxes: DataFrame, size: float = 30.0) -> DataFrame:
    """Pairs of boxes (box, w, s, e, n; not across the antimeridian) and the points in them, by a join on grid cells."""
    cell = lambda c, shift: F.floor((F.col(c) + shift) / size)
    dealt = boxes.withColumn("cx", F.explode(F.sequence(cell("w", 180), cell("e", 180)))).withColumn("cy", F.explode(F.sequence(cell("s", 90), cell("n", 90))))
    return cells(points, size).join(dealt, ["cx", "cy"]).where(F.col("lat").between(F.col("s"), F.col("n")) & F.col("lon").between(F.col("w"), F.col("e"))).drop("cx", "cy")


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Whether a point lies in a ring, an array of (lat, lon), by the even-odd rule; false for fewer than three corners."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))

    def crossed(a: Column, b: Column) -> Column:
        return F.when((a.lat > lat) != (b.lat > lat), (lon < (b.lon - a.lon) * (lat - a.lat) / (b.lat - a.lat) + a.lon).cast("int")).otherwise(0)

    return (F.size(ring) >= 3) & (F.aggregate(F.zip_with(ring, after, crossed), F.lit(0), lambda n, x: n + x) % 2 == 1)


def in_polygons(points: DataFrame, polygons: DataFrame, size: float = 30.0) -> DataFrame:
    """Pairs of polygons (poly, ring; not across the antimeridian) and the points in them: boxes are joined on grid cells, then rings tested."""
    bound = lambda pick, f: pick(F.transform("ring", lambda x: x[f]))
    boxes = polygons.where(F.size("ring") >= 3).select("poly", "ring", bound(F.array_min, "lon").alias("w"), bound(F.array_max, "lon").alias("e"), bound(F.array_min, "lat").alias("s"), bound(F.array_max, "lat").alias("n"))
    return in_boxes(points, boxes, size).where(in_ring(F.col("lat"), F.col("lon"), F.col("ring"))).drop("ring", "w", "e", "s", "n")


def rounded(x: Column, digits: int) -> Column:
    """Half up, away from zero, as coordinates are rounded when they are written."""
    return F.round(x, digits)


def point_feature(entity_id: Column, lat: Column, lon: Column, properties: Column, digits: int = 6) -> Column:
    """A GeoJSON feature of a point, longitude first; the geometry is null where a coordinate is."""
    point = F.struct(F.lit("Point").alias("type"), F.array(rounded(lon, digits), rounded(lat, digits)).alias("coordinates"))
    whole = F.struct(F.lit("Feature").alias("type"), entity_id.cast("string").alias("id"), F.when(lat.isNotNull() & lon.isNotNull(), point).alias("geometry"), properties.alias("properties"))
    return F.to_json(whole, {"ignoreNullFields": "false"})


def parse_points(text: Column) -> Column:
    """Struct (id, lat, lon) of a GeoJSON point feature; null if it is none."""
    f = F.from_json(text, "type string, id string, geometry struct<type string, coordinates array<double>>")
    good = (f.type == "Feature") & (f.geometry.type == "Point") & (F.size(f.geometry.coordinates) >= 2)
    return F.when(good, F.struct(f.id.alias("id"), f.geometry.coordinates[1].alias("lat"), f.geometry.coordinates[0].alias("lon")))


def ring_area_m2(lats: np.ndarray, lons: np.ndarray) -> float:
    """Area of a ring on the sphere of equal area (authalic latitudes), by the trapezoid rule in longitude."""
    e = math.sqrt(E2)

    def q(p: np.ndarray) -> np.ndarray:
        s = np.sin(p)
        return (1 - E2) * (s / (1 - E2 * s**2) - np.log((1 - e * s) / (1 + e * s)) / (2 * e))

    polar = float(q(np.array([math.pi / 2]))[0])
    height = q(np.radians(lats)) / polar
    turn = (np.diff(np.append(lons, lons[0])) + 180) % 360 - 180
    return float(abs(np.sum(np.radians(turn) * (height + np.append(height[1:], height[0])) / 2)) * A**2 * polar / 2)


def polygon_areas(points: DataFrame) -> DataFrame:
    """group, area_m2 of rings given as points (group, place, lat, lon)."""
    kind = points.schema["group"].dataType.simpleString()

    def run(groups: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        g = groups.sort_values("place")
        return pd.DataFrame({"group": [g["group"].iloc[0]], "area_m2": [ring_area_m2(g["lat"].to_numpy(float), g["lon"].to_numpy(float))]})

    return points.groupBy("group").applyInPandas(run, f"group {kind}, area_m2 double")
