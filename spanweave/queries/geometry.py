"""Queries of overlays, relations and tiles of polygons; SQL finds areas by slabs between all corners and crossings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as v
from ..operators import geodesy as gd
from ..operators import overlay as ov
from ..operators import tiles as ti
from .contracts import _STAR, _rings


def _corner(y, x):
    return F.struct(y.cast("double").alias("lat"), x.cast("double").alias("lon"))


def kites(s, d):
    """Around each point a kite of four corners, its size by id: id, label, ring."""
    lat, lon, r = F.round("lat", 6), F.round(F.col("lon") / 2, 6), 1.25 + (F.col("id") % 5) * 0.5
    return v.points(s, d).select("id", "label", F.array(_corner(lat - r, lon), _corner(lat, lon + r * 0.75), _corner(lat + r * 0.5, lon), _corner(lat, lon - r * 0.5)).alias("ring"))


def quads(s, d):
    """Of each four points, in order of id, a ring that may cross itself: id, ring; fewer than four make none."""
    corner = F.struct("id", F.round("lat", 6).alias("lat"), F.round(F.col("lon") / 3, 6).alias("lon"))
    four = v.points(s, d).groupBy(F.floor(F.col("id") / 4).alias("quad")).agg(F.sort_array(F.collect_list(corner)).alias("c")).where(F.size("c") == 4)
    return four.select(F.col("quad").alias("id"), F.transform("c", lambda c: F.struct(c.lat.alias("lat"), c.lon.alias("lon"))).alias("ring"))


def stars(s, d):
    return _rings(s, d).select(F.col("poly").alias("id"), "ring")


def sp14_areas(s, d):
    """Area, in square degrees, of what two labels' stars have together, in all and apart."""
    edges = ov.ring_edges(stars(s, d))
    pairs = ov.candidates(ov.boxes(edges), ov.boxes(edges)).where("a < b AND turn = 0")
    done = ov.outlines(ov.arrangement(ov.paired(pairs, edges, edges), ov.PAIR), ov.PAIR, ov.rules())
    return done.groupBy("a", "b", "kind").agg(F.round(ov.area(), 2).alias("area"))


def sp14_members(s, d):
    """Points in each part of the intersection and difference of two stars, found by the rings of the results."""
    edges = ov.ring_edges(stars(s, d))
    pairs = ov.candidates(ov.boxes(edges), ov.boxes(edges)).where("a < b AND turn = 0")
    done = ov.outlines(ov.arrangement(ov.paired(pairs, edges, edges), ov.PAIR), ov.PAIR, ov.rules())
    results = done.select(F.concat_ws(":", "a", "b", "kind").alias("id"), *ov.POINT)
    where = v.points(s, d).select("id", F.round(F.col("lon") / ov.GRID).cast("long").alias("x"), F.round(F.col("lat") / ov.GRID).cast("long").alias("y"))
    looking = where.select("id", "x", "y", F.col("x").alias("w"), F.col("y").alias("s"), F.col("x").alias("e"), F.col("y").alias("n"))
    held = ti.join_boxes(looking, ov.boxes(results)).select(F.col("l_id").alias("t"), F.col("l_x").alias("x"), F.col("l_y").alias("y"), F.col("r_id").alias("id"))
    return ti.distances(held, results).where("far = 0").groupBy(F.col("id").alias("part")).agg(F.count("*").alias("n"), F.sum("t").alias("ids"))


def sp14_dissolve(s, d):
    """Area that each label's kites cover together."""
    rows = kites(s, d)
    edges = ov.ring_edges(rows).join(rows.select("id", F.col("label").alias("group")), "id")
    return ov.dissolved(edges).groupBy(F.col("group").alias("label")).agg(F.round(ov.area(), 2).alias("area"))


def sp14_repair(s, d):
    """Area inside of each quad by the even-odd rule, and whether the ring had to be cut."""
    edges = ov.ring_edges(quads(s, d))
    done = ov.repaired(edges).groupBy("id").agg(F.round(ov.area(), 2).alias("area"), (F.count("*") > 4).alias("cut"))
    return done


def sp13_relations(s, d):
    """How each kite lies to each star that it meets."""
    one, two = ov.ring_edges(stars(s, d)), ov.ring_edges(kites(s, d))
    pairs = ov.candidates(ov.boxes(one), ov.boxes(two)).where("turn = 0")
    return ov.related(pairs, one, two).where("intersects").select(F.col("a").alias("star"), F.col("b").alias("kite"), "touches", "covers", "within", "equals")


def sp12_box_join(s, d):
    """Kites of different labels whose boxes meet: partners and least partner of each."""
    box = ov.boxes(ov.ring_edges(kites(s, d)).select("id", *ov.POINT)).join(kites(s, d).select("id", "label"), "id")
    return ti.partners(box, "label")


def sp12_nearest(s, d):
    """The two stars nearest to each point, in degrees of the plane; 0 inside."""
    edges = ov.ring_edges(stars(s, d))
    points = v.points(s, d).select(F.col("id").alias("t"), F.round(F.col("lon") / ov.GRID).cast("long").alias("x"), F.round(F.col("lat") / ov.GRID).cast("long").alias("y"))
    found = ti.nearest(points, edges, ov.boxes(edges), 2, 4.0 / ov.GRID)
    return found.select(F.col("t").alias("id"), F.col("id").alias("star"), "place", F.round(F.col("far") * ov.GRID, 3).alias("degrees"))


def _steps(s, d):
    """Each point and a place a hundred degrees on, half as far from the equator on its other side."""
    return v.points(s, d).select("id", "lat", "lon", (-F.col("lat") / 2).alias("lat2"), (F.col("lon") + 100).alias("lon2"))


def sp05_inverse(s, d):
    """Length of the geodesic and its azimuths."""
    g = gd.inverse_of(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return _steps(s, d).select("id", g.alias("g")).select("id", F.round(F.col("g.metres") / 1000, 1).alias("km"), F.round(F.pmod(F.col("g.azimuth1") + 360, F.lit(360.0)), 4).alias("azimuth1"), F.round(F.pmod(F.col("g.azimuth2") + 360, F.lit(360.0)), 4).alias("azimuth2"))


def sp05_to_pole(s, d):
    """Length of the meridian from each point to the north pole, and of the equator to the meridian of Greenwich."""
    north = gd.inverse_of(F.col("lat"), F.col("lon"), F.lit(90.0), F.lit(0.0))
    along = gd.inverse_of(F.lit(0.0), F.col("lon") * 0.9, F.lit(0.0), F.lit(0.0))
    return v.points(s, d).select("id", north.alias("n"), along.alias("e")).select("id", F.round("n.metres", 1).alias("north"), F.round("e.metres", 1).alias("along"))


def sp06_direct(s, d):
    """Where a geodesic of 500 km that begins at an azimuth of 60 degrees ends."""
    end = gd.direct_of(F.col("lat"), F.col("lon"), F.lit(60.0), F.lit(500_000.0))
    return v.points(s, d).select("id", end.alias("g")).select("id", F.round("g.lat", 6).alias("lat"), F.round(F.pmod(F.col("g.lon") + 360, F.lit(360.0)), 6).alias("lon"))


def sp06_round_trip(s, d):
    """Does the geodesic to each point's antipode (all but a little) lead there, to a micrometre, and its middle lie in the middle?"""
    rows = v.points(s, d).select("id", "lat", "lon", (-F.col("lat") * (1 - (F.col("id") % 7) * 0.001)).alias("lat2"), (F.col("lon") + 180 - (F.col("id") % 11) * 0.1).alias("lon2"))
    there = rows.withColumn("g", gd.inverse_of(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).withColumn("end", gd.direct_of(F.col("lat"), F.col("lon"), F.col("g.azimuth1"), F.col("g.metres")))
    middle = there.withColumn("m", gd.between(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"), F.lit(0.5))).withColumn("half", gd.inverse_of(F.col("m.lat"), F.col("m.lon"), F.col("lat2"), F.col("lon2")))
    off = middle.withColumn("off", gd.inverse_of(F.col("end.lat"), F.col("end.lon"), F.col("lat2"), F.col("lon2")))
    return off.select("id", (F.col("off.metres") < 1e-6).alias("there"), (F.abs(F.col("half.metres") * 2 - F.col("g.metres")) < 1e-6).alias("halved"))


def sp07_lunes(s, d):
    """Area, in km2, and perimeter, in m, of an eighth-like piece from the equator to a pole at each point's meridian, less a hole of the same kind."""
    lon, wide = F.round("lon", 6), 10.0 + F.col("id") % 80
    lune = lambda a, b: F.array(_corner(F.lit(0.0), a), _corner(F.lit(0.0), b), _corner(F.when(F.col("id") % 2 == 0, 90.0).otherwise(-90.0), a))
    rows = v.points(s, d).select("id", lune(lon, lon + wide).alias("outer"), lune(lon + 1, lon + 3).alias("hole"))
    parts = rows.select("id", F.posexplode(F.array("outer", "hole")).alias("part", "ring"))
    return gd.polygon_measures(parts).select("id", F.round(F.col("area_m2") / 1e6, 3).alias("km2"), F.round("perimeter_m", 1).alias("metres"))


_F = repr(gd.FLATTENING)
_A, _B = repr(gd.A), repr(gd.B)
#: Vincenty's rounds, which settle where points are far from antipodal.
_VINCENTY = f"""step AS (SELECT id, atan((1-{_F})*tan(radians(lat))) AS u, atan((1-{_F})*tan(radians(-lat/2))) AS w, radians(100.0::DOUBLE) AS l FROM points),
 it AS (SELECT id, u, w, l, l AS lam, 0 AS k FROM step UNION ALL SELECT id, u, w, l, l+(1-c)*{_F}*sa*(atan2(ss,cs)+c*ss*(cm+c*cs*(2*cm*cm-1))), k+1 FROM
   (SELECT *, {_F}/16*ca*(4+{_F}*(4-3*ca)) AS c FROM (SELECT *, 1-sa*sa AS ca, CASE WHEN 1-sa*sa<1e-15 THEN 0 ELSE cs-2*sin(u)*sin(w)/(1-sa*sa) END AS cm FROM (SELECT *, cos(u)*cos(w)*sin(lam)/ss AS sa FROM (SELECT *, sqrt(pow(cos(w)*sin(lam),2)+pow(cos(u)*sin(w)-sin(u)*cos(w)*cos(lam),2)) AS ss, sin(u)*sin(w)+cos(u)*cos(w)*cos(lam) AS cs FROM it WHERE k<30)))))"""
_AGAIN = "(SELECT *, 1-sa*sa AS ca, CASE WHEN 1-sa*sa<1e-15 THEN 0 ELSE cs-2*sin(u)*sin(w)/(1-sa*sa) END AS cm FROM (SELECT *, cos(u)*cos(w)*sin(lam)/ss AS sa FROM (SELECT *, sqrt(pow(cos(w)*sin(lam),2)+pow(cos(u)*sin(w)-sin(u)*cos(w)*cos(lam),2)) AS ss, sin(u)*sin(w)+cos(u)*cos(w)*cos(lam) AS cs FROM it WHERE k=30)))"
_BIG, _SMALL = "(1+q/16384*(4096+q*(q*(320-175*q)-768)))", "(q/1024*(256+q*(q*(74-47*q)-128)))"
_DELTA = f"{_SMALL}*ss*(cm+{_SMALL}/4*(cs*(2*cm*cm-1)-{_SMALL}/6*cm*(4*ss*ss-3)*(4*cm*cm-3)))"
_EP2 = repr(gd.EP2)
#: Vincenty's direct rounds for 500 km at 60 degrees.
_DIRECT = f"""start AS (SELECT id, lon, atan((1-{_F})*tan(radians(lat))) AS u FROM points), base AS (SELECT id, lon, u, atan2(tan(u),cos(radians(60))) AS s1, cos(u)*sin(radians(60)) AS sa FROM start),
 sized AS (SELECT *, (1-sa*sa)*{_EP2} AS q FROM base), big AS (SELECT *, {_BIG} AS ba, {_SMALL} AS bb FROM sized),
 it AS (SELECT *, 500000/({_B}*ba) AS sigma, 0 AS k FROM big UNION ALL SELECT * EXCLUDE (sigma, k, cm, ss, cs), 500000/({_B}*ba)+bb*ss*(cm+bb/4*(cs*(2*cm*cm-1)-bb/6*cm*(4*ss*ss-3)*(4*cm*cm-3))), k+1 FROM (SELECT *, cos(2*s1+sigma) AS cm, sin(sigma) AS ss, cos(sigma) AS cs FROM it WHERE k<12))"""
_MERIDIAN = f"(SELECT sum((CASE WHEN j IN (0, 400) THEN 1 WHEN j%2=1 THEN 4 ELSE 2 END)*{_A}*(1-{gd.E2!r})/pow(1-{gd.E2!r}*pow(sin(radians(lat+(90-lat)*j/400)),2),1.5))*radians(90-lat)/1200 FROM range(401) t(j))"

_KITE = """kite AS (SELECT id, label, round(lat,6) AS y, round(lon/2,6) AS x, 1.25+(id%5)*0.5::DOUBLE AS r FROM points),
 kcorner AS (SELECT id, label, 0 AS k, y-r AS lat, x AS lon FROM kite UNION ALL SELECT id, label, 1, y, x+r*0.75 FROM kite UNION ALL SELECT id, label, 2, y+r*0.5, x FROM kite UNION ALL SELECT id, label, 3, y, x-r*0.5 FROM kite),
 kedge AS (SELECT a.id, a.label, a.lat AS ay, a.lon AS ax, b.lat AS bb, b.lon AS bx FROM kcorner a JOIN kcorner b ON a.id=b.id AND b.k=(a.k+1)%4)"""
_QUAD = """qcorner AS (SELECT id//4 AS id, row_number() OVER (PARTITION BY id//4 ORDER BY id)-1 AS k, count(*) OVER (PARTITION BY id//4) AS n, round(lat,6) AS lat, round(lon/3,6) AS lon FROM points),
 qedge AS (SELECT a.id, a.k, a.lat AS ay, a.lon AS ax, b.lat AS bb, b.lon AS bx FROM qcorner a JOIN qcorner b ON a.id=b.id AND b.k=(a.k+1)%4 WHERE a.n=4)"""
#: Slabs of a table e (g, side, ay, ax, bb, bx): in each, edges by longitude in the middle, and how many of each side lie west of what follows.
_SLABS = """den AS (SELECT p.g, p.ay+(p.bb-p.ay)*(((q.ax-p.ax)*(q.bb-q.ay)-(q.ay-p.ay)*(q.bx-q.ax))/((p.bx-p.ax)*(q.bb-q.ay)-(p.bb-p.ay)*(q.bx-q.ax))) AS y FROM e p JOIN e q ON p.g=q.g AND greatest(p.ay,p.bb)>=least(q.ay,q.bb) AND greatest(q.ay,q.bb)>=least(p.ay,p.bb) WHERE abs((p.bx-p.ax)*(q.bb-q.ay)-(p.bb-p.ay)*(q.bx-q.ax))>1e-12),
 range_ AS (SELECT g, min(ay) AS lo, max(ay) AS hi FROM e GROUP BY g),
 ys AS (SELECT g, ay AS y FROM e UNION SELECT g, y FROM den JOIN range_ USING (g) WHERE y BETWEEN lo AND hi),
 slab AS (SELECT g, y AS y1, lead(y) OVER (PARTITION BY g ORDER BY y) AS y2 FROM ys),
 mid AS (SELECT s.g, y1, y2, side, ax+(bx-ax)*((y1+y2)/2-ay)/(bb-ay) AS x FROM slab s JOIN e ON s.g=e.g AND least(ay,bb)<(y1+y2)/2 AND greatest(ay,bb)>(y1+y2)/2 WHERE y2>y1),
 walk AS (SELECT g, y2-y1 AS h, lead(x) OVER w - x AS wide, sum((side=0)::INT) OVER w AS na, sum((side=1)::INT) OVER w AS nb FROM mid WINDOW w AS (PARTITION BY g, y1 ORDER BY x, side))"""
_IN = "(SELECT poly, id FROM points JOIN edge ON (ay>lat)<>(bb>lat) AND lon<(bx-ax)*(lat-ay)/(bb-ay)+ax GROUP BY ALL HAVING count(*)%2=1)"
_BOXED = "box AS (SELECT poly, min(ay) AS s, max(ay) AS n, min(ax) AS w, max(ax) AS e FROM edge GROUP BY poly), pair AS (SELECT a.poly AS a, b.poly AS b FROM box a JOIN box b ON a.poly<b.poly AND a.w<=b.e AND b.w<=a.e AND a.s<=b.n AND b.s<=a.n)"
_CROSS = "((x1-ax)*(bb-ay)-(y1-ay)*(bx-ax))*((x2-ax)*(bb-ay)-(y2-ay)*(bx-ax))<0 AND ((ax-x1)*(y2-y1)-(ay-y1)*(x2-x1))*((bx-x1)*(y2-y1)-(bb-y1)*(x2-x1))<0"

QUERIES = {
    "sp05_inverse": (sp05_inverse, v.oracle(f"SELECT id, round({_B}*{_BIG}*(atan2(ss,cs)-{_DELTA})/1000,1) AS km, round((degrees(atan2(cos(w)*sin(lam),cos(u)*sin(w)-sin(u)*cos(w)*cos(lam)))+360)%360,4) AS azimuth1, round((degrees(atan2(cos(u)*sin(lam),-sin(u)*cos(w)+cos(u)*sin(w)*cos(lam)))+360)%360,4) AS azimuth2 FROM (SELECT *, ca*{_EP2} AS q FROM {_AGAIN})", "points", recursive=_VINCENTY)),
    "sp05_to_pole": (sp05_to_pole, v.oracle(f"SELECT id, round({_MERIDIAN},1) AS north, round({_A}*radians(abs(lon*0.9)),1) AS along FROM points", "points")),
    "sp06_direct": (sp06_direct, v.oracle(f"SELECT id, round(degrees(atan2(sin(u)*cos(sigma)+cos(u)*sin(sigma)*cos(radians(60)),(1-{_F})*sqrt(sa*sa+pow(sin(u)*sin(sigma)-cos(u)*cos(sigma)*cos(radians(60)),2)))),6) AS lat, round((lon+degrees(lam-(1-c)*{_F}*sa*(sigma+c*sin(sigma)*(cm+c*cos(sigma)*(2*cm*cm-1))))+720)%360,6) AS lon FROM (SELECT *, atan2(sin(sigma)*sin(radians(60)),cos(u)*cos(sigma)-sin(u)*sin(sigma)*cos(radians(60))) AS lam, cos(2*s1+sigma) AS cm, {_F}/16*(1-sa*sa)*(4+{_F}*(4-3*(1-sa*sa))) AS c FROM it WHERE k=12)", "points", recursive=_DIRECT)),
    "sp06_round_trip": (sp06_round_trip, v.oracle("SELECT id, true AS there, true AS halved FROM points", "points")),
    "sp07_lunes": (sp07_lunes, v.oracle(f"SELECT id, round((10+id%80-2)*{gd.C2!r}*pi()/180/1000000,3) AS km2, round({_A}*radians(10+id%80)+2*(SELECT sum((CASE WHEN j IN (0, 400) THEN 1 WHEN j%2=1 THEN 4 ELSE 2 END)*{_A}*(1-{gd.E2!r})/pow(1-{gd.E2!r}*pow(sin(radians(90.0::DOUBLE*j/400)),2),1.5))*radians(90.0::DOUBLE)/1200 FROM range(401) t(j)),1) AS metres FROM points", "points")),
    "sp14_areas": (sp14_areas, v.oracle("SELECT g.a AS a, g.b AS b, kind, round(sum(CASE kind WHEN 'intersection' THEN wide*h*(na%2=1 AND nb%2=1)::INT WHEN 'union' THEN wide*h*(na%2=1 OR nb%2=1)::INT ELSE wide*h*(na%2=1 AND nb%2=0)::INT END),2) AS area FROM walk, (VALUES ('intersection'), ('union'), ('difference')) k(kind) GROUP BY ALL HAVING area>0", "points", recursive=f"{_STAR}, {_BOXED}, e AS (SELECT {{'a': a, 'b': b}} AS g, 0 AS side, ay, ax, bb, bx FROM pair JOIN edge ON poly=a UNION ALL SELECT {{'a': a, 'b': b}}, 1, ay, ax, bb, bx FROM pair JOIN edge ON poly=b), {_SLABS}")),
    "sp14_members": (sp14_members, v.oracle("SELECT a||':'||b||':'||kind AS part, count(*) AS n, sum(id)::BIGINT AS ids FROM (SELECT a, b, p.id, k.kind FROM pair, points p, (VALUES ('intersection'), ('union'), ('difference')) k(kind) WHERE CASE kind WHEN 'intersection' THEN (a, p.id) IN (SELECT (poly, id) FROM held) AND (b, p.id) IN (SELECT (poly, id) FROM held) WHEN 'union' THEN (a, p.id) IN (SELECT (poly, id) FROM held) OR (b, p.id) IN (SELECT (poly, id) FROM held) ELSE (a, p.id) IN (SELECT (poly, id) FROM held) AND NOT (b, p.id) IN (SELECT (poly, id) FROM held) END) GROUP BY ALL", "points", recursive=f"{_STAR}, {_BOXED}, held AS {_IN}")),
    "sp14_dissolve": (sp14_dissolve, v.oracle("SELECT g AS label, round(sum(wide*h*(covered>0)::INT),2) AS area FROM (SELECT g, y2-y1 AS h, lead(x) OVER w - x AS wide, sum(step) OVER w AS covered FROM (SELECT g, y1, y2, x, CASE WHEN x=min(x) OVER (PARTITION BY g, y1, side) THEN 1 ELSE -1 END AS step FROM mid) WINDOW w AS (PARTITION BY g, y1 ORDER BY x, step DESC)) GROUP BY g", "points", recursive=f"{_KITE}, e AS (SELECT label AS g, id AS side, ay, ax, bb, bx FROM kedge), {_SLABS}")),
    "sp14_repair": (sp14_repair, v.oracle(f"SELECT g AS id, round(sum(wide*h*(na%2=1)::INT),2) AS area, any_value(cut) AS cut FROM walk JOIN (SELECT p.id AS g, bool_or({_CROSS}) AS cut FROM (SELECT id, k, ax AS x1, ay AS y1, bx AS x2, bb AS y2 FROM qedge) p JOIN qedge q ON p.id=q.id AND p.k<q.k GROUP BY p.id) USING (g) GROUP BY g", "points", recursive=f"{_QUAD}, e AS (SELECT id AS g, 0 AS side, ay, ax, bb, bx FROM qedge), {_SLABS}")),
    "sp13_relations": (sp13_relations, v.oracle("SELECT star, kite, false AS touches, k4 AND NOT c AS covers, s10 AND NOT c AS within, false AS equals FROM (SELECT star, kite, bool_or(crossed) AS c, bool_and(k_in) AS k4, bool_or(k_in) AS k1, bool_and(s_in) AS s10, bool_or(s_in) AS s1 FROM placed GROUP BY ALL) WHERE c OR k1 OR s1", "points", recursive=f"""{_STAR}, {_KITE},
 kin AS (SELECT poly, id, k FROM kcorner JOIN edge ON (ay>lat)<>(bb>lat) AND lon<(bx-ax)*(lat-ay)/(bb-ay)+ax GROUP BY ALL HAVING count(*)%2=1), sin_ AS (SELECT c.poly, c.k, id FROM corner c JOIN kedge ON (ay>lat)<>(bb>lat) AND lon<(bx-ax)*(lat-ay)/(bb-ay)+ax GROUP BY ALL HAVING count(*)%2=1),
 crossing AS (SELECT DISTINCT p.poly, q.id FROM (SELECT poly, ax AS x1, ay AS y1, bx AS x2, bb AS y2 FROM edge) p JOIN kedge q ON {_CROSS}),
 placed AS (SELECT s.poly AS star, kc.id AS kite, (s.poly, kc.id) IN (SELECT (poly, id) FROM crossing) AS crossed, (s.poly, kc.id, kc.k) IN (SELECT (poly, id, k) FROM kin) AS k_in, (s.poly, s.k, kc.id) IN (SELECT (poly, k, id) FROM sin_) AS s_in FROM corner s, kcorner kc)""")),
    "sp12_box_join": (sp12_box_join, v.oracle("SELECT a.id, count(*) AS n, min(b.id) AS first FROM kb a JOIN kb b ON a.label<>b.label AND a.w<=b.e AND b.w<=a.e AND a.s<=b.n AND b.s<=a.n GROUP BY a.id", "points", recursive=f"{_KITE}, kb AS (SELECT id, label, min(round(lon*1e9)::BIGINT) AS w, max(round(lon*1e9)::BIGINT) AS e, min(round(lat*1e9)::BIGINT) AS s, max(round(lat*1e9)::BIGINT) AS n FROM kcorner GROUP BY ALL)")),
    "sp12_nearest": (sp12_nearest, v.oracle(f"SELECT id, star, place, round(far,3) AS degrees FROM (SELECT id, star, far, row_number() OVER (PARTITION BY id ORDER BY round(far,9), star)::INTEGER AS place FROM (SELECT p.id, e.poly AS star, CASE WHEN (e.poly, p.id) IN (SELECT (poly, id) FROM held) THEN 0 ELSE min(sqrt(pow(lon-ax-(bx-ax)*greatest(0,least(1,((lon-ax)*(bx-ax)+(lat-ay)*(bb-ay))/((bx-ax)*(bx-ax)+(bb-ay)*(bb-ay)))),2)+pow(lat-ay-(bb-ay)*greatest(0,least(1,((lon-ax)*(bx-ax)+(lat-ay)*(bb-ay))/((bx-ax)*(bx-ax)+(bb-ay)*(bb-ay)))),2))) END AS far FROM points p, edge e GROUP BY p.id, e.poly)) WHERE place<=2", "points", recursive=f"{_STAR}, held AS {_IN}")),
}
