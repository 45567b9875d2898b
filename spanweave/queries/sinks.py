"""Queries of sinks and snapshots, edge delays, recoveries, geodesy, quantities and distributions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import views as v
from ..operators import propagation as p
from ..operators import spatial as sp
from ..operators import stats as st
from ..operators import temporal as t
from ..plans.lineage import shared_folder
from ..sources import formats


def io01_write_parquet(s, d):
    """Rows written as Parquet and read again."""
    path = shared_folder(s, "rows")
    formats.write_rows(v.table(s, d, "part").select("p_partkey", "p_brand", "p_size"), path)
    return s.read.parquet(path)


def io05_snapshots(s, d):
    """Two snapshots of the trade graph in one store; the second is read."""
    path, edges = shared_folder(s, "snapshots"), v.trade_edges(s, d)
    formats.save_snapshot(edges.limit(0), path, "first")
    formats.save_snapshot(edges, path, "second")
    return formats.load_snapshot(s, path, "second").select("src", "dst", "weight")


def io09_arrow_tables(s, d):
    """The trade graph as two Arrow tables: their rows and columns."""
    nodes = v.table(s, d, "nation").select(F.col("n_name").alias("node"))
    tables = formats.arrow_tables(nodes, v.trade_edges(s, d))
    return s.createDataFrame([(k, x.num_rows, ",".join(x.column_names)) for k, x in tables.items()], "name string, n long, fields string")


def p04_delay(s, d):
    n = F.col("l_linenumber")
    found = p.edge_delay(F.when(n == 1, F.col("l_quantity") * 60), F.when(n <= 2, F.lit(3600.0)), F.when(n == 3, F.col("l_quantity") * 10), 5.0)
    return v.table(s, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.round(F.sum(found), 2).alias("seconds"))


def a10_world_summary(s, d):
    """Entities by type and relationships by kind, with a fingerprint of the counts."""
    n = F.count("*").alias("n")
    counts = v.entities(s, d).groupBy(F.concat(F.lit("entity:"), "entity_type").alias("what")).agg(n).unionByName(v.relationships(s, d).groupBy(F.concat(F.lit("relationship:"), "kind").alias("what")).agg(n))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("what", "n"))), lambda x: F.concat(x.what, F.lit("="), x.n)), ";")
    return counts.unionByName(counts.agg(lines.alias("lines")).select(F.concat(F.lit("fingerprint:"), F.sha2("lines", 256)).alias("what"), F.lit(0).cast("long").alias("n")))


def u03_quantities(s, d):
    """Sizes in inches: in metres, three times as long, plus half a foot, and as a share of a yard."""
    inch = F.lit(0.0254)
    metres = F.col("p_size") * inch
    return v.table(s, d, "part").select("p_partkey", F.round(metres, 9).alias("metres"), F.round(metres * 3, 9).alias("scaled"), F.round((metres + 0.5 * 0.3048) / inch, 6).alias("plus_inches"), F.round(metres / 0.9144, 9).alias("yards"))


def sp05_bearing(s, d):
    return v.points(s, d).select("id", F.round(sp.bearing(F.col("lat"), F.col("lon"), F.lit(48.0), F.lit(2.0)), 5).alias("bearing"))


def sp06_destination(s, d):
    lat, lon = sp.destination(F.col("lat"), F.col("lon"), F.lit(60.0), F.lit(500.0))
    return v.points(s, d).select("id", F.round(lat, 5).alias("lat"), F.round(lon, 5).alias("lon"))


def sp08_ecef_inverse(s, d):
    lat, lon, height = sp.from_ecef(*sp.ecef(F.col("lat"), F.col("lon"), F.lit(100.0)))
    return v.points(s, d).select("id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"), F.round(height, 2).alias("height"))


def io20_hazards(s, d):
    """Points in each hazard's box; one box crosses the date line."""
    found = None
    for name, box in (("east", (10.0, -20.0, 60.0, 40.0)), ("line", (170.0, -60.0, -150.0, 60.0)), ("pole", (-180.0, 70.0, 180.0, 90.0))):
        inside = v.points(s, d).where(sp.in_box(F.col("lat"), F.col("lon"), *box)).agg(F.count("*").alias("n")).select(F.lit(name).alias("hazard"), "n")
        found = inside if found is None else found.unionByName(inside)
    return found


def z02_entity_distance(s, d):
    """Distance between a point and the next of its label; null where either has no coordinates."""
    q = v.points(s, d).withColumn("lat", F.when(F.col("id") % 7 != 0, F.col("lat")))
    other = q.select((F.col("id") - 1).alias("id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return q.join(other, "id").select("id", F.round(sp.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 5).alias("km"))


def n01_uniform(s, d):
    """Density, distribution and its inverse of the uniform distribution on 10 .. 40."""
    x, q = F.col("p_size"), (F.col("p_size") % 10) / 10
    return v.table(s, d, "part").select("p_partkey", F.when((x >= 10) & (x <= 40), 1 / 30).otherwise(0.0).cast("double").alias("pdf"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - 10) / 30)), 9).alias("cdf"), F.round(10 + 30 * q, 9).alias("ppf"))


def n01_lognormal(s, d):
    """Density of the log-normal distribution of parameters 2 and 0.5; 0 below 0."""
    x = F.col("p_size").cast("double")
    pdf = F.exp(-F.pow(F.log(x) - 2, 2) / 0.5) / (x * 0.5 * math.sqrt(2 * math.pi))
    return v.table(s, d, "part").select("p_partkey", F.round(F.when(x > 0, pdf).otherwise(0.0), 12).alias("pdf"))


def c02_exponential(s, d):
    """Recovery of each part from an impaired capacity, towards 1 in 24 hours at 0.2 an hour."""
    points = p.recovery_points(F.col("p_size") / 100, 1.0, 24.0, 0.2)
    return v.table(s, d, "part").select("p_partkey", F.explode(points).alias("p")).select("p_partkey", F.round("p.hour", 6).alias("hour"), F.round("p.capacity", 9).alias("capacity"))


def k06_best_intervention(s, d):
    """Of the brands as interventions, the one of largest benefit; then least cost, then name."""
    per = v.table(s, d, "part").groupBy("p_brand").agg(F.round(F.sum("p_retailprice"), 2).alias("cost"), F.count("*").alias("benefit"))
    return per.orderBy(F.desc("benefit"), "cost", "p_brand").limit(1)


def j01_open_bounds(s, d):
    """Interval join within owners where every fifth start and every seventh end is open."""
    rows = v.intervals(s, d).withColumns({"s": F.when(F.col("id") % 5 != 0, F.col("s")), "e": F.when(F.col("id") % 7 != 0, F.col("e"))})
    return t.interval_join(rows, rows.select("id", "owner", "s", "e"), 128, ["owner"]).where("l_id < r_id").groupBy("owner").agg(F.count("*").alias("pairs"), F.min("s").alias("first"), F.max("e").alias("last"))


def a19_brand_median(s, d):
    """Lower median price of each brand, by ranks over counted values."""
    prices = v.table(s, d, "part").select(F.col("p_brand").alias("g"), F.col("p_retailprice").alias("x"))
    middle = st.rank_value(prices, ["g"], "x", F.ceil(F.col("_all") / 2), "median")
    return middle.select(F.col("g").alias("brand"), F.round("median", 4).alias("median"))


_BEAR = "(degrees(atan2(sin(radians(2-lon))*cos(radians(48)), cos(radians(lat))*sin(radians(48))-sin(radians(lat))*cos(radians(48))*cos(radians(2-lon))))+360)"
_TO = "asin(sin(radians(lat))*cos(500/6371.0088)+cos(radians(lat))*sin(500/6371.0088)*cos(radians(60)))"
_OPEN = "SELECT id, owner, CASE WHEN id%5<>0 THEN s END AS s, CASE WHEN id%7<>0 THEN e END AS e FROM ivals"
QUERIES = {
    "io01_write_parquet": (io01_write_parquet, "SELECT p_partkey, p_brand, p_size FROM part"),
    "io05_snapshots": (io05_snapshots, v.oracle("SELECT src, dst, weight FROM tedges", "tedges")),
    "io09_arrow_tables": (io09_arrow_tables, v.oracle("SELECT 'vertices' AS name, (SELECT count(*) FROM nation) AS n, 'node' AS fields UNION ALL SELECT 'relationships', (SELECT count(*) FROM tedges), 'src,dst,weight'", "tedges")),
    "p04_delay": (p04_delay, "SELECT l_returnflag, l_linenumber, round(sum(CASE WHEN l_linenumber=1 THEN l_quantity*60 WHEN l_linenumber=2 THEN 3600 WHEN l_linenumber=3 THEN l_quantity*10 ELSE 5 END),2)::DOUBLE AS seconds FROM lineitem GROUP BY 1,2"),
    "a10_world_summary": (a10_world_summary, v.oracle("SELECT what, n FROM counts UNION ALL SELECT 'fingerprint:'||sha256(string_agg(what||'='||n, ';' ORDER BY what)), 0 FROM counts", "entities", "supplies", "serves", "located", recursive="counts AS (SELECT 'entity:'||entity_type AS what, count(*) AS n FROM entities GROUP BY 1 UNION ALL SELECT 'relationship:'||kind, count(*) FROM (SELECT kind FROM supplies UNION ALL SELECT kind FROM serves UNION ALL SELECT kind FROM located) GROUP BY 1)")),
    "u03_quantities": (u03_quantities, "SELECT p_partkey, round(p_size*0.0254::DOUBLE,9) AS metres, round(p_size*0.0254::DOUBLE*3,9) AS scaled, round(p_size+6::DOUBLE,6) AS plus_inches, round(p_size*0.0254::DOUBLE/0.9144::DOUBLE,9) AS yards FROM part"),
    "sp05_bearing": (sp05_bearing, v.oracle(f"SELECT id, round({_BEAR}-360*floor({_BEAR}/360),5) AS bearing FROM points", "points")),
    "sp06_destination": (sp06_destination, v.oracle(f"SELECT id, round(degrees({_TO}),5) AS lat, round(l+180-360*floor((l+180)/360)-180,5) AS lon FROM (SELECT *, lon+degrees(atan2(sin(radians(60))*sin(500/6371.0088)*cos(radians(lat)), cos(500/6371.0088)-sin(radians(lat))*sin({_TO}))) AS l FROM points)", "points")),
    "sp08_ecef_inverse": (sp08_ecef_inverse, v.oracle("SELECT id, round(lat,6) AS lat, round(lon,6) AS lon, 100.0::DOUBLE AS height FROM points", "points")),
    "io20_hazards": (io20_hazards, v.oracle("SELECT 'east' AS hazard, count(*) AS n FROM points WHERE lon BETWEEN 10 AND 60 AND lat BETWEEN -20 AND 40 UNION ALL SELECT 'line', count(*) FROM points WHERE (lon>=170 OR lon<=-150) AND lat BETWEEN -60 AND 60 UNION ALL SELECT 'pole', count(*) FROM points WHERE lat BETWEEN 70 AND 90", "points")),
    "z02_entity_distance": (z02_entity_distance, v.oracle("SELECT a.id, CASE WHEN a.id%7<>0 AND b.id%7<>0 THEN round(2*6371.0088*asin(least(1, sqrt(pow(sin(radians(b.lat-a.lat)/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2),2)))),5) END AS km FROM points a JOIN points b ON b.id=a.id+1", "points")),
    "n01_uniform": (n01_uniform, "SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 40 THEN 1/30::DOUBLE ELSE 0 END AS pdf, round(least(1, greatest(0, (p_size-10)/30::DOUBLE)),9) AS cdf, round(10+30*(p_size%10)/10::DOUBLE,9) AS ppf FROM part"),
    "n01_lognormal": (n01_lognormal, "SELECT p_partkey, round(CASE WHEN p_size>0 THEN exp(-pow(ln(p_size)-2,2)/0.5)/(p_size*0.5*sqrt(2*pi())) ELSE 0 END,12) AS pdf FROM part"),
    "c02_exponential": (c02_exponential, "SELECT p_partkey, round(24*i/8::DOUBLE,6) AS hour, round(1-(1-p_size/100::DOUBLE)*exp(-0.2*24*i/8),9) AS capacity FROM part, range(0,9) r(i)"),
    "k06_best_intervention": (k06_best_intervention, "SELECT p_brand, round(sum(p_retailprice),2)::DOUBLE AS cost, count(*) AS benefit FROM part GROUP BY 1 ORDER BY benefit DESC, cost, p_brand LIMIT 1"),
    "j01_open_bounds": (j01_open_bounds, v.oracle(f"SELECT owner, count(*) AS pairs, min(greatest(ls, rs)) AS first, max(least(le, re)) AS last FROM (SELECT l.owner, l.s AS ls, l.e AS le, r.s AS rs, r.e AS re FROM ({_OPEN}) l JOIN ({_OPEN}) r ON l.owner=r.owner AND l.id<r.id) WHERE (ls IS NULL OR re IS NULL OR ls<re) AND (rs IS NULL OR le IS NULL OR rs<le) GROUP BY owner", "ivals")),
    "a19_brand_median": (a19_brand_median, "SELECT p_brand AS brand, round(quantile_disc(p_retailprice, 0.5),4)::DOUBLE AS median FROM part GROUP BY 1"),
}
