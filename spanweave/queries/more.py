"""Queries of stored graphs, scenario trees, provenance levels, further geometry and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as v
from ..operators import graph as g
from ..operators import spatial as sp
from ..operators import temporal as t
from ..operators import workflow as wf
from ..plans.lineage import cut
from ..sources import formats
from ..streaming import events as ev


def a28_graph_digest(s, d):
    """Whether the digest of the trade graph stays the same when its rows come in another order."""
    nodes, edges = v.table(s, d, "nation").select(F.col("n_name").alias("node")), cut(v.trade_edges(s, d))
    one, two = formats.digest(nodes, edges), formats.digest(nodes.orderBy(F.desc("node")), edges.orderBy(F.desc("weight")))
    return s.createDataFrame([(one == two, nodes.count(), edges.count())], "stable boolean, nodes long, edges long")


def io03_upsert(s, d):
    c = v.table(s, d, "customer").select("c_custkey", "c_acctbal")
    new = c.where("c_custkey % 5 = 0").select((F.col("c_custkey") + 3).alias("c_custkey"), F.lit(0.0).alias("c_acctbal"))
    return formats.merge_rows(c, new, "c_custkey")


def io24_markdown(s, d):
    return formats.as_markdown(v.table(s, d, "nation").select("n_nationkey", "n_name"))


def sc04_tree(s, d):
    """Nations as branches under their regions, under one root; a nation's guard holds where its key is even."""
    r = v.table(s, d, "region").select(F.col("r_name").alias("node"), F.lit("root").alias("parent"), (F.col("r_regionkey") != 2).alias("holds"))
    n = v.table(s, d, "nation").join(v.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("n:"), "n_name").alias("node"), F.col("r_name").alias("parent"), (F.col("n_nationkey") % 2 == 0).alias("holds"))
    root = s.createDataFrame([("root", None, True)], "node string, parent string, holds boolean")
    return wf.walk_tree(root.unionByName(r).unionByName(n)).select("node", "depth", F.array_join("path", ">").alias("path"))


def sc06_tree_problems(s, d):
    rows = v.table(s, d, "nation").select(F.concat(F.lit("n:"), "n_nationkey").alias("node"), F.when(F.col("n_nationkey") == 0, None).when(F.col("n_nationkey") == 7, F.lit("n:99")).when(F.col("n_nationkey") == 9, F.lit("n:9")).otherwise(F.concat(F.lit("n:"), F.floor((F.col("n_nationkey") - 1) / 2))).alias("parent"))
    return wf.tree_problems(rows)


def v02_levels(s, d):
    c = v.table(s, d, "conversations")
    node = F.concat("conv_id", F.lit(":"), "turn")
    edges = c.where("turn > 0").select(F.concat("conv_id", F.lit(":"), F.col("turn") - 1).alias("src"), node.alias("dst"))
    return g.topological_levels(c.select(node.alias("node")), edges)


def sp06_midpoint(s, d):
    """Midpoint on the sphere of each point and (48, 2)."""
    p1, p2, dl = F.radians("lat"), F.radians(F.lit(48.0)), F.radians(F.lit(2.0) - F.col("lon"))
    x, y = F.cos(p2) * F.cos(dl), F.cos(p2) * F.sin(dl)
    lat = F.atan2(F.sin(p1) + F.sin(p2), F.sqrt(F.pow(F.cos(p1) + x, 2) + y * y))
    lon = F.radians("lon") + F.atan2(y, F.cos(p1) + x)
    return v.points(s, d).select("id", F.round(F.degrees(lat), 6).alias("lat"), F.round(sp.normalize_longitude(F.degrees(lon)), 6).alias("lon"))


def sp15_bounds(s, d):
    return v.points(s, d).groupBy("label").agg(*[F.round(f(c), 6).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))])


def s05_interval_intersection(s, d):
    p = v.intervals(s, d).groupBy("owner").agg(F.max("s").alias("lower"), F.min("e").alias("upper"))
    return p.select("owner", F.when(F.col("lower") < F.col("upper"), F.col("lower")).alias("lower"), F.when(F.col("lower") < F.col("upper"), F.col("upper")).alias("upper"))


def t15_index(s, d):
    """Versions by record in order of validity, with the gap to the next."""
    rows = v.versions(s, d).where(t.overlaps(t.instant(v.AT), t.instant("1999-01-01 00:00:00")))
    return rows.groupBy("record_key").agg(F.count("*").alias("n"), F.min("valid_from").alias("first"), F.max("valid_from").alias("last"))


def st_tumbling(s, d):
    """The hourly buckets of events as a stream over the same files."""
    schema = s.read.parquet(f"{d}/events.parquet").schema
    return ev.drain(ev.tumbling(ev.read_events(s, f"{d}/events.parquet*", schema)), f"tumbling_{abs(hash(d))}")


def st_sessions(s, d):
    w = F.session_window(F.col("ts").cast("timestamp"), "30 minutes")
    return v.table(s, d, "events").groupBy(w, "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


QUERIES = {
    "a28_graph_digest": (a28_graph_digest, v.oracle("SELECT true AS stable, (SELECT count(*) FROM nation) AS nodes, (SELECT count(*) FROM tedges) AS edges", "tedges")),
    "io03_upsert": (io03_upsert, "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey+3 FROM customer WHERE c_custkey%5=0) UNION ALL SELECT c_custkey+3, 0.0::DOUBLE FROM customer WHERE c_custkey%5=0"),
    "io24_markdown": (io24_markdown, "SELECT '| '||n_nationkey||' | '||n_name||' |' AS line FROM nation"),
    "sc04_tree": (sc04_tree, "SELECT 'root' AS node, 0 AS depth, 'root' AS path UNION ALL SELECT r_name, 1, 'root>'||r_name FROM region WHERE r_regionkey<>2 UNION ALL SELECT 'n:'||n_name, 2, 'root>'||r_name||'>n:'||n_name FROM nation JOIN region ON n_regionkey=r_regionkey WHERE r_regionkey<>2 AND n_nationkey%2=0"),
    "sc06_tree_problems": (sc06_tree_problems, "WITH RECURSIVE b AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey=0 THEN NULL WHEN n_nationkey=7 THEN 99 WHEN n_nationkey=9 THEN 9 ELSE (n_nationkey-1)//2 END AS p FROM nation), r AS (SELECT k FROM b WHERE p IS NULL UNION SELECT b.k FROM b JOIN r ON b.p=r.k) SELECT 'n:'||k AS node, 'unknown parent' AS problem FROM b WHERE p IS NOT NULL AND p NOT IN (SELECT k FROM b) UNION ALL SELECT 'n:'||k, 'no root' FROM b WHERE k NOT IN (SELECT k FROM r)"),
    "v02_levels": (v02_levels, "SELECT conv_id||':'||turn AS node, turn::INTEGER AS level FROM conversations"),
    "sp06_midpoint": (sp06_midpoint, v.oracle("SELECT id, round(degrees(atan2(sin(p1)+sin(p2), sqrt(pow(cos(p1)+x,2)+y*y))),6) AS lat, round(CASE WHEN r=-180 AND l>0 THEN 180 ELSE r END,6)::DOUBLE AS lon FROM (SELECT *, (l+180)-360*floor((l+180)/360)-180 AS r FROM (SELECT *, degrees(radians(lon)+atan2(y, cos(p1)+x)) AS l FROM (SELECT id, lon, radians(lat) AS p1, radians(48.0::DOUBLE) AS p2, cos(radians(48.0::DOUBLE))*cos(radians(2-lon)) AS x, cos(radians(48.0::DOUBLE))*sin(radians(2-lon)) AS y FROM points)))", "points")),
    "sp15_bounds": (sp15_bounds, v.oracle("SELECT label, round(min(lat),6) AS min_lat, round(max(lat),6) AS max_lat, round(min(lon),6) AS min_lon, round(max(lon),6) AS max_lon FROM points GROUP BY label", "points")),
    "s05_interval_intersection": (s05_interval_intersection, v.oracle("SELECT owner, CASE WHEN l<u THEN l END AS lower, CASE WHEN l<u THEN u END AS upper FROM (SELECT owner, max(s) AS l, min(e) AS u FROM ivals GROUP BY owner)", "ivals")),
    "t15_index": (t15_index, v.oracle(f"SELECT record_key, count(*) AS n, min(valid_from) AS first, max(valid_from) AS last FROM versions WHERE (valid_to IS NULL OR valid_to > TIMESTAMP '{v.AT}') AND valid_from < TIMESTAMP '1999-01-01' GROUP BY record_key", "versions")),
    "st_tumbling": (st_tumbling, "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY 1,2"),
    "st_sessions": (st_sessions, "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts-p>=INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)) GROUP BY user_id, k"),
}
