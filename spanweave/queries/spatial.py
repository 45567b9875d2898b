"""Queries of points, boxes, distances, grids and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import views as v
from ..operators import geodesy as gd
from ..operators import spatial as sp

BOX = (170.0, -40.0, -20.0, 45.0)


def sp01_bbox(s, d):
    return v.points(s, d).where(sp.in_box(F.col("lat"), F.col("lon"), *BOX)).select("id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def sp02_bbox_ops(s, d):
    """Boxes of labels: which meet, and their intersection."""
    b = v.points(s, d).groupBy("label").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    a, c = b.select(*[F.col(x).alias(f"a{x}") for x in b.columns]), b.select(*[F.col(x).alias(f"b{x}") for x in b.columns])
    hit = a.join(c, (F.col("alabel") < F.col("blabel")) & (F.col("aw") <= F.col("be")) & (F.col("bw") <= F.col("ae")) & (F.col("as") <= F.col("bn")) & (F.col("bs") <= F.col("an")))
    return hit.select("alabel", "blabel", F.round(F.greatest("aw", "bw"), 6).alias("west"), F.round(F.least("ae", "be"), 6).alias("east"), F.round(F.greatest("as", "bs"), 6).alias("south"), F.round(F.least("an", "bn"), 6).alias("north"))


def sp03_min_arc(s, d):
    """Least arc of longitudes that holds each label's points: what the widest gap leaves."""
    w = Window.partitionBy("label").orderBy("lon")
    p = v.points(s, d).select("label", "lon").distinct()
    first = p.groupBy("label").agg(F.min("lon").alias("f"))
    g = p.withColumn("next", F.lead("lon").over(w)).join(first, "label").select("label", "lon", F.coalesce("next", "f").alias("to"), (F.coalesce("next", F.col("f") + 360) - F.col("lon")).alias("gap"))
    return g.groupBy("label").agg(F.max_by(F.struct("lon", "to", "gap"), F.struct("gap", "lon")).alias("m")).select("label", F.round("m.to", 6).alias("west"), F.round("m.lon", 6).alias("east"), F.round(360 - F.col("m.gap"), 6).alias("width"))


def sp04_haversine(s, d):
    return v.points(s, d).select("id", F.round(sp.haversine_km(F.col("lat"), F.col("lon"), F.lit(48.0), F.lit(2.0)), 5).alias("km"), F.round(2 * sp.RADIUS_KM * F.sin(sp.central_angle(F.col("lat"), F.col("lon"), F.lit(48.0), F.lit(2.0)) / 2), 5).alias("chord_km"))


def sp05_geodesic(s, d):
    return v.points(s, d).select("id", F.round(gd.inverse_of(F.col("lat"), F.col("lon"), F.lit(48.0), F.lit(2.0)).metres, 3).alias("m"))


def sp07_polygon(s, d):
    w = Window.partitionBy("label").orderBy("id")
    ring = v.points(s, d).withColumn("k", F.row_number().over(w)).where("k <= 4")
    corner = ring.select(F.col("label").alias("group"), F.col("k").alias("place"), (F.lit(10.0) + F.when(F.col("k").isin(3, 4), 1.0).otherwise(0.0) + F.col("label") * 0.01).alias("lat"), (F.lit(20.0) + F.when(F.col("k").isin(2, 3), 1.0).otherwise(0.0)).alias("lon"))
    return sp.polygon_areas(corner).select("group", F.round("area_m2", 1).alias("area_m2"))


def sp08_ecef(s, d):
    x, y, z = sp.ecef(F.col("lat"), F.col("lon"), F.lit(100.0))
    return v.points(s, d).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(z, 3).alias("z"))


def sp09_radius(s, d):
    km = sp.haversine_km(F.col("lat"), F.col("lon"), F.lit(0.0), F.lit(0.0))
    return v.points(s, d).select("id", F.round(km, 5).alias("km")).where("km <= 3000").orderBy("km", "id").limit(40)


def j08_radius_join(s, d):
    p = v.points(s, d)
    return sp.within_km(p, p, 200.0).where("l_id <> r_id").select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), F.round("km", 5).alias("km"))


def k04_knn(s, d):
    """Three nearest points of each of a set of targets (a stated set against all points)."""
    p = v.points(s, d)
    return sp.nearest(p.where("id % 100 = 0"), p, 3).select("t", "id", "km", "place")


def sp10_grid(s, d):
    return sp.cells(v.points(s, d), 30.0).groupBy(F.col("cx").cast("long").alias("cx"), F.col("cy").cast("long").alias("cy")).agg(F.count("*").alias("n"), F.min("id").alias("first"))


def sp16_mercator(s, d):
    lat = F.greatest(F.lit(-85.06), F.least(F.lit(85.06), F.col("lat")))
    return v.points(s, d).select("id", F.round(sp.A * F.radians("lon"), 3).alias("x"), F.round(sp.A * F.log(F.tan(F.pi() / 4 + F.radians(lat) / 2)), 3).alias("y"))


def sp17_geojson(s, d):
    p = v.points(s, d)
    text = F.concat(F.lit('{"type":"Feature","id":'), "id", F.lit(',"label":'), "label", F.lit("}"))
    return p.select("id", text.alias("feature"), F.get_json_object(text, "$.type").alias("kind"))


def sp20_longitudes(s, d):
    x = F.col("lon") * 3
    return v.points(s, d).select("id", F.round(sp.normalize_longitude(x), 6).alias("lon"), F.round(F.pmod(x, F.lit(360.0)), 6).alias("azimuth"))


def w10_polyline(s, d):
    w = Window.partitionBy("label").orderBy("id")
    seg = v.points(s, d).select("label", "lat", "lon", F.lag("lat").over(w).alias("a"), F.lag("lon").over(w).alias("b"))
    return seg.groupBy("label").agg(F.round(F.coalesce(F.sum(sp.haversine_km(F.col("a"), F.col("b"), F.col("lat"), F.col("lon"))), F.lit(0.0)), 2).alias("km"))


R = sp.RADIUS_KM


def _hav(a: str, b: str, c: str, e: str) -> str:
    return f"(2*asin(least(1.0, sqrt(pow(sin((radians({c})-radians({a}))/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({e}-({b}))/2),2)))))"


P = "points"
N_ = f"{sp.A}/sqrt(1-{sp.E2}*pow(sin(radians(lat)),2))"
QUERIES = {
    "sp01_bbox": (sp01_bbox, v.oracle("SELECT id, round(lat,6) AS lat, round(lon,6) AS lon FROM points WHERE lat BETWEEN -40 AND 45 AND (lon>=170 OR lon<=-20)", P)),
    "sp02_bbox_ops": (sp02_bbox_ops, v.oracle("SELECT a.label AS alabel, b.label AS blabel, round(greatest(a.w,b.w),6) AS west, round(least(a.e,b.e),6) AS east, round(greatest(a.s,b.s),6) AS south, round(least(a.n,b.n),6) AS north FROM bx a JOIN bx b ON a.label<b.label AND a.w<=b.e AND b.w<=a.e AND a.s<=b.n AND b.s<=a.n", P, recursive="bx AS (SELECT label, min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM points GROUP BY label)")),
    "sp03_min_arc": (sp03_min_arc, v.oracle("SELECT label, round(arg_max(t,(gap,lon)),6) AS west, round(arg_max(lon,(gap,lon)),6) AS east, round(360-max(gap),6) AS width FROM (SELECT label, lon, coalesce(lead(lon) OVER w, min(lon) OVER (PARTITION BY label)) AS t, coalesce(lead(lon) OVER w, min(lon) OVER (PARTITION BY label)+360)-lon AS gap FROM (SELECT DISTINCT label, lon FROM points) WINDOW w AS (PARTITION BY label ORDER BY lon)) GROUP BY label", P)),
    "sp04_haversine": (sp04_haversine, v.oracle(f"SELECT id, round({R}*{_hav('lat','lon','48.0::DOUBLE','2.0::DOUBLE')},5) AS km, round(2*{R}*sin({_hav('lat','lon','48.0::DOUBLE','2.0::DOUBLE')}/2),5) AS chord_km FROM points", P)),
    "sp05_geodesic": (sp05_geodesic, None),
    "sp07_polygon": (sp07_polygon, None),
    "sp08_ecef": (sp08_ecef, v.oracle(f"SELECT id, round(({N_}+100)*cos(radians(lat))*cos(radians(lon)),3) AS x, round(({N_}+100)*cos(radians(lat))*sin(radians(lon)),3) AS y, round(({N_}*(1-{sp.E2})+100)*sin(radians(lat)),3) AS z FROM points", P)),
    "sp09_radius": (sp09_radius, v.oracle(f"SELECT id, round({R}*{_hav('lat','lon','0.0::DOUBLE','0.0::DOUBLE')},5) AS km FROM points WHERE round({R}*{_hav('lat','lon','0.0::DOUBLE','0.0::DOUBLE')},5)<=3000 ORDER BY km, id LIMIT 40", P)),
    "j08_radius_join": (j08_radius_join, v.oracle(f"SELECT a.id AS a, b.id AS b, round({R}*{_hav('a.lat','a.lon','b.lat','b.lon')},5) AS km FROM points a JOIN points b ON a.id<>b.id AND {R}*{_hav('a.lat','a.lon','b.lat','b.lon')}<=200", P)),
    "k04_knn": (k04_knn, v.oracle(f"SELECT t, id, km, place FROM (SELECT t.id AS t, p.id AS id, round({R}*{_hav('p.lat','p.lon','t.lat','t.lon')},6) AS km, row_number() OVER (PARTITION BY t.id ORDER BY round({R}*{_hav('p.lat','p.lon','t.lat','t.lon')},6), p.id) AS place FROM points t JOIN points p ON t.id%100=0 AND p.id<>t.id) WHERE place<=3", P)),
    "sp10_grid": (sp10_grid, v.oracle("SELECT floor((lon+180)/30)::BIGINT AS cx, floor((lat+90)/30)::BIGINT AS cy, count(*) AS n, min(id) AS first FROM points GROUP BY 1,2", P)),
    "sp16_mercator": (sp16_mercator, v.oracle(f"SELECT id, round({sp.A}*radians(lon),3) AS x, round({sp.A}*ln(tan(pi()/4+radians(greatest(-85.06::DOUBLE,least(85.06::DOUBLE,lat)))/2)),3) AS y FROM points", P)),
    "sp17_geojson": (sp17_geojson, v.oracle("""SELECT id, '{"type":"Feature","id":'||id||',"label":'||label||'}' AS feature, 'Feature' AS kind FROM points""", P)),
    "sp20_longitudes": (sp20_longitudes, v.oracle("SELECT id, round(CASE WHEN r=-180 AND x>0 THEN 180 ELSE r END,6)::DOUBLE AS lon, round(x-360*floor(x/360),6) AS azimuth FROM (SELECT id, lon*3 AS x, (lon*3+180)-360*floor((lon*3+180)/360)-180 AS r FROM points)", P)),
    "w10_polyline": (w10_polyline, v.oracle(f"SELECT label, round(coalesce(sum({R}*{_hav('a','b','lat','lon')}) FILTER (WHERE a IS NOT NULL),0),2) AS km FROM (SELECT label, lat, lon, lag(lat) OVER w AS a, lag(lon) OVER w AS b FROM points WINDOW w AS (PARTITION BY label ORDER BY id)) GROUP BY label", P)),
}
