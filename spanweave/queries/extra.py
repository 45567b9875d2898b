"""Queries of the remaining small operators: labels, convergence, rounding, deltas, units, records."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import views as v
from ..functions import scalars as sc
from ..operators import graph as g
from ..operators import spatial as sp
from . import graph as gq
from . import spatial as sq


def _first(s, d):
    return v.trade_edges(s, d).agg(F.min("src")).first()[0]


def g05_bfs_labels(s, d):
    root = s.createDataFrame([(_first(s, d),)], "root string").where("root IS NOT NULL")
    hops = g.hops_from(v.trade_edges(s, d), root, 25)
    return hops.select("node", "hops", F.row_number().over(Window.orderBy("hops", "node")).cast("long").alias("place"))


def g09_pagerank_converged(s, d):
    nodes = v.table(s, d, "nation").select(F.col("n_name").alias("node"))
    return g.pagerank_until(nodes, v.trade_edges(s, d), 1e-9, weight="weight").select("node", F.round("rank", 6).alias("rank"))


def g12_shortest_labels(s, d):
    edges = v.trade_edges(s, d).withColumn("cost", F.lit(1.0))
    path = F.when(F.col("node").isNotNull(), F.array_join("path", ">"))  # without edges, the one row has no node
    return g.shortest(edges, _first(s, d), "cost").select("node", F.col("cost").alias("cost"), path.alias("path"))


def k05_best_per_end(s, d):
    """Best path to each end within three steps, by product of weights."""
    edges = v.trade_edges(s, d)
    found = g.paths(edges, _first(s, d), 3, "weight")
    w = Window.partitionBy("node").orderBy(F.round("score", 12).desc(), "hops", "path")
    return found.withColumn("n", F.row_number().over(w)).where("n = 1").select("node", F.array_join("path", ">").alias("path"), F.round("score", 9).alias("score"))


def p09_influence(s, d):
    e = v.table(s, d, "events")
    return e.groupBy("event_type").agg(F.round(F.max(F.col("value") / (F.col("user_id") % 5 + 1)), 6).alias("influence"), F.sha2(F.array_join(F.sort_array(F.collect_set(F.col("user_id").cast("string"))), ">"), 256).alias("signature"))


def c04_continuity_score(s, d):
    p = v.table(s, d, "part")
    return p.select("p_partkey", F.round(F.when(F.col("p_size") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("p_retailprice") / 1000 / F.col("p_size") * 20)), 9).alias("score"))


def s04_attribute_delta(s, d):
    """Before and after of maps, by key."""
    o = v.table(s, d, "supplier").select("s_suppkey", F.create_map(F.lit("a"), F.col("s_nationkey").cast("int"), F.lit("b"), F.lit(1)).alias("x"), F.create_map(F.lit("b"), (F.col("s_suppkey") % 2).cast("int"), F.lit("c"), F.lit(3)).alias("y"))
    both = F.map_zip_with("x", "y", lambda k, a, b: F.struct(a.alias("before"), b.alias("after")))
    return o.select("s_suppkey", F.explode(both).alias("key", "d")).where(~F.col("d.before").eqNullSafe(F.col("d.after"))).select("s_suppkey", "key", "d.before", "d.after")


def f20_shock_targets(s, d):
    a = F.array(F.concat(F.lit("supplier:"), "s_suppkey"))
    b = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.concat(F.lit("nation:"), "s_nationkey"), F.lit("all"))).otherwise(F.array(F.lit("all")))
    return v.table(s, d, "supplier").select("s_suppkey", F.array_join(F.array_sort(F.array_union(a, b)), ",").alias("targets"))


def t14_unix_seconds(s, d):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return v.table(s, d, "events").select("event_id", (micros / 1000000).alias("seconds"), F.timestamp_micros(micros).cast("timestamp_ntz").alias("back"))


def t10_version_ids(s, d):
    o = v.versions(s, d)
    return o.select("version_id", F.concat(F.lit("version:"), F.substring(F.sha2(F.concat_ws("|", F.col("record_key"), F.col("version_id"), F.date_format("valid_from", "yyyy-MM-dd'T'HH:mm:ss'Z'")), 256), 1, 32)).alias("id"))


def sp11_box_index(s, d):
    """Points in each label's box, shrunk to its middle third."""
    p = v.points(s, d)
    b = p.groupBy(F.col("label").alias("box")).agg(F.min("lat").alias("s0"), F.max("lat").alias("n0"), F.min("lon").alias("w0"), F.max("lon").alias("e0"))
    third = lambda lo, hi, k: F.col(lo) + (F.col(hi) - F.col(lo)) * k / 3
    b = b.select("box", third("s0", "n0", 1).alias("s"), third("s0", "n0", 2).alias("n"), third("w0", "e0", 1).alias("w"), third("w0", "e0", 2).alias("e"))
    return sp.in_boxes(p, b).groupBy("box").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def sp18_jsonfg(s, d):
    p = v.points(s, d)
    t = F.concat(F.lit('{"type":"Feature","id":"'), "id", F.lit('","time":{"interval":["1998-01-01T00:00:00Z",".."]}}'))
    return p.select("id", F.get_json_object(t, "$.time.interval[1]").alias("end"), F.length(t).cast("long").alias("n"))


def sp20_boxes(s, d):
    """Centre and width of boxes that may cross the antimeridian."""
    p = v.points(s, d).select("id", F.col("lon").alias("w"), sp.normalize_longitude(F.col("lon") + 100).alias("e"))
    width = F.when(F.col("w") <= F.col("e"), F.col("e") - F.col("w")).otherwise(F.col("e") - F.col("w") + 360)
    return p.select("id", F.round(width, 6).alias("width"), (F.col("w") > F.col("e")).alias("crosses"), F.round(sp.normalize_longitude(F.col("w") + width / 2), 6).alias("centre"))


def u01_compatible(s, d):
    """Which of the units that parts are measured in convert into which, by equal dimensions, and how many parts have one of both."""
    turn = F.col("p_partkey") % 6
    unit, dimension = (F.element_at(F.array(*[F.lit(x) for x in names.split()]), (turn + 1).cast("int")) for names in ("m km ft s h kg", "L L L T T M"))
    units = v.table(s, d, "part").groupBy(unit.alias("unit"), dimension.alias("dimension")).agg(F.count("*").alias("n"))
    one, two = units.select("dimension", F.col("unit").alias("one"), F.col("n").alias("n1")), units.select("dimension", F.col("unit").alias("other"), F.col("n").alias("n2"))
    return one.join(two, "dimension").where("one < other").select("one", "other", (F.col("n1") + F.col("n2")).alias("parts"))


def m03_rounding(s, d):
    x = F.col("l_extendedprice").cast("decimal(18,4)") * F.lit(1) / 8
    x = x.cast("decimal(18,6)")
    return v.table(s, d, "lineitem").agg(F.sum(F.round(x, 2)).cast("double").alias("half_up"), F.sum(F.floor(x)).cast("double").alias("floor"), F.sum(F.ceil(x)).cast("double").alias("ceiling"))


def m04_legacy_round(s, d):
    @F.pandas_udf("double")
    def python_round(x: pd.Series) -> pd.Series:
        return x.map(lambda y: round(y, 2))

    return v.table(s, d, "part").select("p_partkey", python_round(F.col("p_retailprice") / 8).alias("usd"))


def n03_uniform(s, d):
    """Deterministic uniform numbers, one a part: how many fall in each sixteenth, and their sum."""
    u = sc.uniform("seed", F.col("p_partkey"))
    return v.table(s, d, "part").select(u.alias("u")).groupBy(F.floor(F.col("u") * 16).alias("cell")).agg(F.count("*").alias("n"), F.round(F.sum("u"), 6).alias("total"))


def o01_rank(s, d):
    """Interventions by gain per cost, feasible ones first."""
    c = v.table(s, d, "customer").groupBy("c_nationkey").agg(F.round(F.sum(F.abs("c_acctbal")), 2).alias("cost"), F.count("*").alias("gain"))
    ok = F.col("cost") <= 300000
    w = Window.orderBy(F.desc(ok), F.desc(F.round(F.col("gain") / F.col("cost"), 12)), "c_nationkey")
    return c.select("c_nationkey", ok.alias("feasible"), F.row_number().over(w).cast("long").alias("place"))


def x05_normalised_record(s, d):
    text = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    row = F.concat(F.lit('{"brand":"'), text("p_brand"), F.lit('","name":"'), text("p_name"), F.lit('"}'))
    return v.table(s, d, "part").select("p_partkey", F.sha2(row, 256).alias("digest"))


def a26_portfolio_capacity(s, d):
    per = v.table(s, d, "supplier").groupBy("s_nationkey").agg(F.round(F.least(F.lit(1.0), 0.3 + F.sum(0.1 * F.abs("s_acctbal") / 10000)), 6).alias("capacity"))
    return per


def a27_unique_sorted(s, d):
    return v.table(s, d, "lineitem").select("l_returnflag", "l_linenumber").distinct().groupBy("l_returnflag").agg(F.array_join(F.array_sort(F.collect_list("l_linenumber")).cast("array<string>"), ",").alias("lines"))


def j06_edge_length(s, d):
    """Length of the edge from each point to the next of its label."""
    w = Window.partitionBy("label").orderBy("id")
    p = v.points(s, d)
    e = p.select(F.col("id").alias("src"), F.lead("id").over(w).alias("dst")).where("dst is not null")
    a, b = p.select(F.col("id").alias("src"), F.col("lat").alias("a"), F.col("lon").alias("o")), p.select(F.col("id").alias("dst"), F.col("lat").alias("c"), F.col("lon").alias("q"))
    return e.join(a, "src").join(b, "dst").select("src", "dst", F.round(sp.haversine_km(F.col("a"), F.col("o"), F.col("c"), F.col("q")), 5).alias("km"))


def z04_valid_points(s, d):
    p = v.points(s, d).withColumn("x", F.col("lon") * 1.2)
    return p.groupBy(F.col("x").between(-180, 180).alias("valid")).agg(F.count("*").alias("n"))


def z07_intervention_maps(s, d):
    c = v.table(s, d, "supplier").select(F.array(F.concat(F.lit("n:"), "s_nationkey"), F.concat(F.lit("n:"), (F.col("s_nationkey") + 1) % 25)).alias("ids"), (F.col("s_suppkey") % 5 / 10).alias("r"))
    return c.select(F.explode("ids").alias("entity"), "r").groupBy("entity").agg(F.round(F.max("r"), 6).alias("reduction"))


HAV = sq._hav
QUERIES = {
    "g05_bfs_labels": (g05_bfs_labels, v.oracle("SELECT node, h AS hops, row_number() OVER (ORDER BY h, node) AS place FROM best WHERE root=(SELECT min(src) FROM tedges)", "tedges", recursive=gq.HOPS)),
    "g09_pagerank_converged": (g09_pagerank_converged, v.oracle("SELECT node, round(rank,6) AS rank FROM r60", "tedges", recursive=gq._sweeps(True, 60))),
    "g12_shortest_labels": (g12_shortest_labels, v.oracle("SELECT node, min(cost) AS cost, array_to_string(arg_min(path, (cost, path)),'>') AS path FROM sp GROUP BY node", "tedges", recursive=gq.SHORT.format(c="1.0"))),
    "k05_best_per_end": (k05_best_per_end, v.oracle("SELECT node, array_to_string(arg_min(path, (-round(exp(-cost),12), h, path)),'>') AS path, round(max(exp(-cost)),9) AS score FROM sp WHERE h BETWEEN 1 AND 3 GROUP BY node", "tedges", recursive=gq.SHORT.format(c="(-ln(e.weight))"))),
    "p09_influence": (p09_influence, "SELECT event_type, round(max(value/(user_id%5+1)),6) AS influence, sha256(string_agg(DISTINCT user_id::VARCHAR,'>' ORDER BY user_id::VARCHAR)) AS signature FROM events GROUP BY 1"),
    "c04_continuity_score": (c04_continuity_score, "SELECT p_partkey, round(CASE WHEN p_size=0 THEN 1 ELSE least(1.0, p_retailprice/1000/p_size*20) END,9)::DOUBLE AS score FROM part"),
    "s04_attribute_delta": (s04_attribute_delta, "SELECT s_suppkey, 'a' AS key, s_nationkey AS before, NULL::INTEGER AS after FROM supplier UNION ALL SELECT s_suppkey, 'b', 1, (s_suppkey%2)::INTEGER FROM supplier WHERE s_suppkey%2<>1 UNION ALL SELECT s_suppkey, 'c', NULL, 3 FROM supplier"),
    "f20_shock_targets": (f20_shock_targets, "SELECT s_suppkey, array_to_string(list_sort(CASE WHEN s_suppkey%2=0 THEN ['supplier:'||s_suppkey,'nation:'||s_nationkey,'all'] ELSE ['supplier:'||s_suppkey,'all'] END),',') AS targets FROM supplier"),
    "t14_unix_seconds": (t14_unix_seconds, "SELECT event_id, epoch_us(ts)/1000000 AS seconds, ts AS back FROM events"),
    "t10_version_ids": (t10_version_ids, v.oracle("SELECT version_id, 'version:'||substr(sha256(record_key||'|'||version_id||'|'||strftime(valid_from,'%Y-%m-%dT%H:%M:%SZ')),1,32) AS id FROM versions", "versions")),
    "sp11_box_index": (sp11_box_index, v.oracle("SELECT box, count(*) AS n, min(id) AS first FROM points JOIN (SELECT label AS box, min(lat)+(max(lat)-min(lat))*1/3 AS s, min(lat)+(max(lat)-min(lat))*2/3 AS n, min(lon)+(max(lon)-min(lon))*1/3 AS w, min(lon)+(max(lon)-min(lon))*2/3 AS e FROM points GROUP BY label) ON lat BETWEEN s AND n AND lon BETWEEN w AND e GROUP BY box", "points")),
    "sp18_jsonfg": (sp18_jsonfg, v.oracle("""SELECT id, '..' AS "end", length('{"type":"Feature","id":"'||id||'","time":{"interval":["1998-01-01T00:00:00Z",".."]}}')::BIGINT AS n FROM points""", "points")),
    "sp20_boxes": (sp20_boxes, v.oracle("SELECT id, round(wd,6) AS width, w>e AS crosses, round(CASE WHEN c=-180 AND w+wd/2>0 THEN 180 ELSE c END,6)::DOUBLE AS centre FROM (SELECT *, (w+wd/2+180)-360*floor((w+wd/2+180)/360)-180 AS c FROM (SELECT id, w, e, CASE WHEN w<=e THEN e-w ELSE e-w+360 END AS wd FROM (SELECT id, lon AS w, CASE WHEN r=-180 AND lon+100>0 THEN 180 ELSE r END::DOUBLE AS e FROM (SELECT id, lon, (lon+100+180)-360*floor((lon+100+180)/360)-180 AS r FROM points))))", "points")),
    "u01_compatible": (u01_compatible, "WITH u AS (SELECT ['m','km','ft','s','h','kg'][p_partkey%6+1] AS unit, ['L','L','L','T','T','M'][p_partkey%6+1] AS dim, count(*) AS n FROM part GROUP BY ALL) SELECT a.unit AS one, b.unit AS other, a.n+b.n AS parts FROM u a JOIN u b ON a.dim=b.dim AND a.unit<b.unit"),
    "m03_rounding": (m03_rounding, "SELECT sum(round(x,2))::DOUBLE AS half_up, sum(floor(x))::DOUBLE AS floor, sum(ceil(x))::DOUBLE AS ceiling FROM (SELECT (l_extendedprice::DECIMAL(18,4)*1/8)::DECIMAL(18,6) AS x FROM lineitem)"),
    "m04_legacy_round": (m04_legacy_round, None),
    "n03_uniform": (n03_uniform, "SELECT floor(u*16)::BIGINT AS cell, count(*) AS n, round(sum(u),6) AS total FROM (SELECT ('0x'||substr(sha256('seed:'||p_partkey),1,12))::BIGINT/281474976710656.0::DOUBLE AS u FROM part) GROUP BY 1"),
    "o01_rank": (o01_rank, "SELECT c_nationkey, cost<=300000 AS feasible, row_number() OVER (ORDER BY cost<=300000 DESC, round(gain/cost,12) DESC, c_nationkey) AS place FROM (SELECT c_nationkey, round(sum(abs(c_acctbal)),2) AS cost, count(*) AS gain FROM customer GROUP BY 1)"),
    "x05_normalised_record": (x05_normalised_record, """SELECT p_partkey, sha256('{"brand":"'||lower(trim(regexp_replace(p_brand,'\\s+',' ','g')))||'","name":"'||lower(trim(regexp_replace(p_name,'\\s+',' ','g')))||'"}') AS digest FROM part"""),
    "a26_portfolio_capacity": (a26_portfolio_capacity, "SELECT s_nationkey, round(least(1.0, 0.3+sum(0.1*abs(s_acctbal)/10000)),6)::DOUBLE AS capacity FROM supplier GROUP BY 1"),
    "a27_unique_sorted": (a27_unique_sorted, "SELECT l_returnflag, array_to_string(list_sort(list_distinct(list(l_linenumber))),',') AS lines FROM lineitem GROUP BY 1"),
    "j06_edge_length": (j06_edge_length, v.oracle(f"SELECT src, dst, round({sp.RADIUS_KM}*{HAV('a','o','c','q')},5) AS km FROM (SELECT id AS src, lat AS a, lon AS o, lead(id) OVER w AS dst, lead(lat) OVER w AS c, lead(lon) OVER w AS q FROM points WINDOW w AS (PARTITION BY label ORDER BY id)) WHERE dst IS NOT NULL", "points")),
    "z04_valid_points": (z04_valid_points, v.oracle("SELECT lon*1.2::DOUBLE BETWEEN -180 AND 180 AS valid, count(*) AS n FROM points GROUP BY 1", "points")),
    "z07_intervention_maps": (z07_intervention_maps, "SELECT entity, round(max(r),6)::DOUBLE AS reduction FROM (SELECT 'n:'||s_nationkey AS entity, s_suppkey%5/10 AS r FROM supplier UNION ALL SELECT 'n:'||((s_nationkey+1)%25), s_suppkey%5/10 FROM supplier) GROUP BY 1"),
}
