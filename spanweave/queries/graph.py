"""Queries of graph selection, traversal, ranking, paths, components and flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as v
from ..operators import graph as g
from ..operators import temporal as t

ROOT = "supplier:1"
SWEEPS = 8


def _live(s, d):
    return v.relationships(s, d).where(t.active_at(t.instant(v.AT)))


def _nodes(s, d):
    return v.table(s, d, "nation").select(F.col("n_name").alias("node"))


def f09_induced(s, d):
    keep = v.entities(s, d).where("entity_type in ('country', 'region') or entity_id rlike '^customer:.*7$'").select("entity_id")
    rels = v.relationships(s, d).join(keep.withColumnRenamed("entity_id", "src"), "src", "left_semi").join(keep.withColumnRenamed("entity_id", "dst"), "dst", "left_semi")
    return rels.select("relationship_id", "src", "dst", "kind")


def f10_edges_from(s, d):
    return _live(s, d).where((F.col("src") == ROOT) & F.col("kind").isin("supplies")).select("relationship_id", "dst", "strength")


def f11_neighbors(s, d):
    near = g.both_ways(_live(s, d)).where(F.col("src") == "part:7").select(F.col("dst").alias("node")).distinct()
    return near


def g01_reachable(s, d):
    return g.reachable(_live(s, d), ROOT).select("node")


def g02_neighborhood(s, d):
    live = _live(s, d).where("kind in ('supplies', 'located_in')")
    return g.reachable(g.both_ways(live), "part:7", 2).select("node")


def g03_bfs_levels(s, d):
    return g.reachable(_live(s, d), ROOT).select("node", F.col("hops").cast("int").alias("level"))


def g04_dfs(s, d):
    e = v.trade_edges(s, d)
    return g.depth_first(e, e.agg(F.min("src")).first()[0])


def g06_cut(s, d):
    kept = _live(s, d).where("not (kind = 'located_in' and src like 'supplier:%')")
    hit = g.reachable(kept, ROOT).where("node like 'nation:%'").agg(F.count("*").alias("n"))
    return hit.select((F.col("n") == 0).alias("disconnected"))


def g08_static_pagerank(s, d):
    return g.pagerank(_nodes(s, d), v.trade_edges(s, d), SWEEPS, renormalise=True).select("node", F.round("rank", 9).alias("rank"))


def g07_pagerank(s, d):
    return g.pagerank(_nodes(s, d), v.trade_edges(s, d), SWEEPS, weight="weight").select("node", F.round("rank", 9).alias("rank"))


def g28_linear(s, d):
    seeds = _nodes(s, d).withColumn("value", F.when(F.substring("node", -1, 1) == "1", 1.0).otherwise(0.0))
    return g.diffuse(_nodes(s, d), v.trade_edges(s, d), seeds, 4, 0.5).select("node", F.round("value", 9).alias("value"))


def _two_hops(s, d):
    return v.supplies(s, d).where(t.active_at(t.instant(v.AT))).unionByName(v.serves(s, d).where(t.active_at(t.instant(v.AT)))).withColumn("score", F.col("strength") * F.col("capacity"))


def g10_reliable_paths(s, d):
    found = g.paths(_two_hops(s, d), ROOT, 3).where("node like 'customer:%'").select(F.array_join("path", ">").alias("path"), "hops", F.round("score", 9).alias("score"))
    return found.orderBy(F.desc("score"), "hops", "path").limit(10)


def s06_entities_on_paths(s, d):
    return g.paths(_two_hops(s, d), ROOT, 3).where("node like 'customer:%'").select(F.explode("path").alias("entity")).distinct()


def g11_shortest_path(s, d):
    edges = v.trade_edges(s, d).withColumn("cost", 1 / F.col("weight"))
    first = edges.agg(F.min("src")).first()[0]
    return g.shortest(edges, first, "cost").select("node", F.round("cost", 6).alias("cost"))


def g13_most_reliable(s, d):
    edges = v.trade_edges(s, d).withColumn("cost", -F.log("weight"))
    first = edges.agg(F.min("src")).first()[0]
    return g.shortest(edges, first, "cost").select("node", F.round(F.exp(-F.col("cost")), 9).alias("reliability"))


def g14_degree_centrality(s, d):
    e, n = v.trade_edges(s, d), _nodes(s, d)
    total = n.count()
    ins, outs = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i")), e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o"))
    share = lambda c: F.round(F.coalesce(c, F.lit(0)) / (total - 1), 9)
    return n.join(ins, "node", "left").join(outs, "node", "left").select("node", share("i").alias("indegree"), share("o").alias("outdegree"))


def a08_stats(s, d):
    live, nodes = _live(s, d), v.entities(s, d).select(F.col("entity_id").alias("node"))
    ends = live.select(F.explode(F.array("src", "dst")).alias("node"))
    degree = nodes.join(ends.groupBy("node").agg(F.count("*").alias("k")), "node", "left").select(F.coalesce("k", F.lit(0)).alias("k"))
    shape = degree.agg(F.count("*").alias("nodes"), F.sum(F.when(F.col("k") == 0, 1).otherwise(0)).alias("isolated"), F.max("k").alias("max_degree"), F.round(F.avg("k"), 6).alias("average_degree"))
    rels = live.agg(F.count("*").alias("edges"), F.sum(F.when(F.col("src") == F.col("dst"), 1).otherwise(0)).alias("self_loops"))
    return shape.crossJoin(rels).select("*", F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 12).alias("density"))


def g15_closeness(s, d):
    return g.closeness(_nodes(s, d), v.trade_edges(s, d)).select("node", F.round("closeness", 9).alias("closeness"))


def g16_betweenness(s, d):
    return g.betweenness(_nodes(s, d), v.trade_edges(s, d)).select("node", F.round("betweenness", 9).alias("betweenness"))


def g17_hops(s, d):
    return g.hops_from(v.trade_edges(s, d), _nodes(s, d).select(F.col("node").alias("root")), 25).where("hops > 0").select("root", "node", "hops")


def g18_wcc(s, d):
    e = _live(s, d).where("kind = 'member_of' or (kind = 'located_in' and src like 'supplier:%')")
    nodes = g.both_ways(e).select(F.col("src").alias("node")).distinct()
    return g.weak_components(nodes, e)


def g19_scc(s, d):
    return g.strong_components(_nodes(s, d), v.trade_edges(s, d))


def g20_articulation(s, d):
    return g.articulation_points(v.relationships(s, d).where("kind in ('member_of')").unionByName(v.located(s, d).where("src like 'supplier:%'")))


def g21_topo_levels(s, d):
    e = v.relationships(s, d).where("kind in ('supplies', 'serves')")
    return g.topological_levels(None, e).groupBy("level").agg(F.count("*").alias("n"), F.min("node").alias("first"))


def g22_max_flow(s, d):
    e = v.trade_edges(s, d)
    a, b = e.agg(F.min("src"), F.max("dst")).first()
    value, flows, side = g.max_flow(e, a, b)
    rows = [(x, y, round(f, 9), x in side and y not in side) for x, y, f in flows if f > 1e-12 or (x in side and y not in side)]
    return s.createDataFrame(rows, "src string, dst string, flow double, in_cut boolean").withColumn("value", F.lit(round(value, 9)))


def g24_snapshot(s, d):
    ents = v.entities(s, d).groupBy(F.col("entity_type").alias("kind")).agg(F.count("*").alias("n"))
    return ents.unionByName(_live(s, d).groupBy("kind").agg(F.count("*").alias("n")))


def g25_remove(s, d):
    """Edges left after a third of the parts is removed, with all their relationships."""
    gone = v.table(s, d, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("part:"), "p_partkey").alias("x"))
    left = v.relationships(s, d).join(gone, F.col("src") == F.col("x"), "left_anti").join(gone, F.col("dst") == F.col("x"), "left_anti")
    return left.groupBy("kind").agg(F.count("*").alias("n"))


def g27_edge_score(s, d):
    return g.paths(_two_hops(s, d), ROOT, 2).where("hops = 2").groupBy("node").agg(F.round(F.max(F.pow("score", 1 / F.col("hops"))), 9).alias("geometric_mean"))


def s01_merge(s, d):
    """Union of two overlapping graphs; a collision is an id with two contents."""
    both = v.supplies(s, d).unionByName(v.supplies(s, d).withColumn("strength", F.when(F.col("relationship_id").endswith("7"), 0.5).otherwise(F.col("strength"))))
    per = both.distinct().groupBy("relationship_id").agg(F.count("*").alias("k"))
    return per.agg(F.count("*").alias("relationships"), F.sum(F.when(F.col("k") > 1, 1).otherwise(0)).alias("collisions"))


def j12_bitemporal_traverse(s, d):
    known = v.serves(s, d).withColumn("known_from", F.col("valid_from") + F.expr("interval 3 days"))
    live = known.where(t.active_at(t.instant(v.AT)) & (F.col("known_from") <= t.instant(v.AT))).select("src", "dst").unionByName(v.supplies(s, d).where(t.active_at(t.instant(v.AT))).select("src", "dst"))
    return g.reachable(live, ROOT).select("node")


ON = f"(valid_from IS NULL OR valid_from <= TIMESTAMP '{v.AT}') AND (valid_to IS NULL OR TIMESTAMP '{v.AT}' < valid_to)"
LIVE = f"live AS (SELECT * FROM rels WHERE {ON})"
REACH = LIVE + f", walk AS (SELECT dst AS node, 1 AS h FROM live WHERE src='{ROOT}' UNION SELECT l.dst, w.h+1 FROM walk w JOIN live l ON l.src=w.node WHERE w.h<16)"
TWO = f"steps AS (SELECT src, dst, strength*capacity AS score FROM supplies WHERE {ON} UNION ALL SELECT src, dst, strength*capacity FROM serves WHERE {ON}), p AS (SELECT a.src||'>'||a.dst||'>'||b.dst AS path, 2 AS hops, round(a.score*b.score,9) AS score, a.dst AS mid, b.dst AS node, a.score*b.score AS raw FROM steps a JOIN steps b ON a.dst=b.src WHERE a.src='{ROOT}')"
HOPS = "hop AS (SELECT n_name AS root, n_name AS node, 0 AS h FROM nation UNION SELECT hop.root, e.dst, hop.h+1 FROM hop JOIN tedges e ON e.src=hop.node WHERE hop.h<25), best AS (SELECT root, node, min(h) AS h FROM hop GROUP BY ALL)"


def _sweeps(weighted: bool, n: int, damping: float = 0.85) -> str:
    w = "weight" if weighted else "1.0"
    out = [f"st AS MATERIALIZED (SELECT src, dst, sum({w})/any_value(t) AS p FROM tedges JOIN (SELECT src, sum({w}) AS t FROM tedges GROUP BY src) USING (src) GROUP BY src, dst)", "r0 AS MATERIALIZED (SELECT n_name AS node, 1.0::DOUBLE/(SELECT count(*) FROM nation) AS rank FROM nation)"]
    for k in range(1, n + 1):
        out.append(f"r{k} AS MATERIALIZED (SELECT n_name AS node, (1-{damping})/(SELECT count(*) FROM nation) + {damping}*(coalesce(told,0) + coalesce((SELECT sum(rank) FROM r{k-1} WHERE node NOT IN (SELECT src FROM st)),0)/(SELECT count(*) FROM nation)) AS rank FROM nation LEFT JOIN (SELECT dst, sum(rank*p) AS told FROM r{k-1} JOIN st ON src=node GROUP BY dst) ON dst=n_name)")
    return ", ".join(out)


def _diffusion(n: int) -> str:
    out = ["d0 AS MATERIALIZED (SELECT n_name AS node, CASE WHEN right(n_name,1)='1' THEN 1.0::DOUBLE ELSE 0.0 END AS value FROM nation)"]
    for k in range(1, n + 1):
        out.append(f"d{k} AS MATERIALIZED (SELECT d0.node, d0.value + 0.5*coalesce(told,0) AS value FROM d0 LEFT JOIN (SELECT dst, sum(value*weight) AS told FROM d{k-1} JOIN tedges ON src=node GROUP BY dst) ON dst=d0.node)")
    return ", ".join(out)


SHORT = "sp AS (SELECT (SELECT min(src) FROM tedges) AS node, 0.0::DOUBLE AS cost, 0 AS h, [(SELECT min(src) FROM tedges)] AS path UNION ALL SELECT e.dst, sp.cost + {c}, sp.h+1, list_append(sp.path, e.dst) FROM sp JOIN tedges e ON e.src=sp.node WHERE sp.h<6 AND NOT list_contains(sp.path, e.dst))"
WCC = "we AS (SELECT src, dst FROM located WHERE kind='member_of' OR src LIKE 'supplier:%'), ud AS (SELECT src, dst FROM we UNION SELECT dst, src FROM we), wr AS (SELECT src AS root, src AS node FROM ud UNION SELECT wr.root, ud.dst FROM wr JOIN ud ON ud.src=wr.node)"

QUERIES = {
    "f09_induced": (f09_induced, v.oracle("SELECT relationship_id, src, dst, kind FROM rels WHERE src IN (SELECT entity_id FROM k) AND dst IN (SELECT entity_id FROM k)", "entities", "rels", recursive="k AS (SELECT entity_id FROM entities WHERE entity_type IN ('country','region') OR regexp_matches(entity_id,'^customer:.*7$'))")),
    "f10_edges_from": (f10_edges_from, v.oracle(f"SELECT relationship_id, dst, strength FROM rels WHERE {ON} AND src='{ROOT}' AND kind='supplies'", "rels")),
    "f11_neighbors": (f11_neighbors, v.oracle(f"SELECT DISTINCT CASE WHEN src='part:7' THEN dst ELSE src END AS node FROM rels WHERE {ON} AND (src='part:7' OR dst='part:7')", "rels")),
    "g01_reachable": (g01_reachable, v.oracle("SELECT DISTINCT node FROM walk", "rels", recursive=REACH)),
    "g02_neighborhood": (g02_neighborhood, v.oracle("SELECT DISTINCT node FROM (SELECT dst AS node FROM ud WHERE src='part:7' UNION SELECT b.dst FROM ud a JOIN ud b ON a.dst=b.src WHERE a.src='part:7') WHERE node<>'part:7'", "rels", recursive=LIVE + ", ud AS (SELECT src, dst FROM live WHERE kind IN ('supplies','located_in') UNION SELECT dst, src FROM live WHERE kind IN ('supplies','located_in'))")),
    "g03_bfs_levels": (g03_bfs_levels, v.oracle("SELECT node, min(h) AS level FROM walk GROUP BY node", "rels", recursive=REACH)),
    "g04_dfs": (g04_dfs, None),
    "g06_cut": (g06_cut, v.oracle("SELECT count(*)=0 AS disconnected FROM walk WHERE node LIKE 'nation:%'", "rels", recursive=f"live AS (SELECT * FROM rels WHERE {ON} AND NOT (kind='located_in' AND src LIKE 'supplier:%'))" + REACH[len(LIVE):])),
    "g07_pagerank": (g07_pagerank, v.oracle(f"SELECT node, round(rank,9) AS rank FROM r{SWEEPS}", "tedges", recursive=_sweeps(True, SWEEPS))),
    "g08_static_pagerank": (g08_static_pagerank, v.oracle(f"SELECT node, round(rank/(SELECT sum(rank) FROM r{SWEEPS}),9) AS rank FROM r{SWEEPS}", "tedges", recursive=_sweeps(False, SWEEPS))),
    "g28_linear": (g28_linear, v.oracle("SELECT node, round(value,9) AS value FROM d4", "tedges", recursive=_diffusion(4))),
    "g10_reliable_paths": (g10_reliable_paths, v.oracle("SELECT path, hops, score FROM p WHERE node LIKE 'customer:%' ORDER BY score DESC, hops, path LIMIT 10", "supplies", "serves", recursive=TWO)),
    "s06_entities_on_paths": (s06_entities_on_paths, v.oracle(f"SELECT DISTINCT unnest(['{ROOT}', mid, node]) AS entity FROM p", "supplies", "serves", recursive=TWO)),
    "g11_shortest_path": (g11_shortest_path, v.oracle("SELECT node, round(min(cost),6) AS cost FROM sp GROUP BY node", "tedges", recursive=SHORT.format(c="1/e.weight"))),
    "g13_most_reliable": (g13_most_reliable, v.oracle("SELECT node, round(exp(-min(cost)),9) AS reliability FROM sp GROUP BY node", "tedges", recursive=SHORT.format(c="(-ln(e.weight))"))),
    "g14_degree_centrality": (g14_degree_centrality, v.oracle("SELECT n_name AS node, round((SELECT count(*) FROM tedges WHERE dst=n_name)/((SELECT count(*) FROM nation)-1),9) AS indegree, round((SELECT count(*) FROM tedges WHERE src=n_name)/((SELECT count(*) FROM nation)-1),9) AS outdegree FROM nation", "tedges")),
    "a08_stats": (a08_stats, v.oracle("SELECT count(*) AS nodes, sum(CASE WHEN k=0 THEN 1 ELSE 0 END)::BIGINT AS isolated, max(k) AS max_degree, round(avg(k),6) AS average_degree, any_value(ed) AS edges, any_value(sl)::BIGINT AS self_loops, round(any_value(ed)/(count(*)*(count(*)-1)),12) AS density FROM (SELECT entity_id, coalesce(k,0) AS k FROM entities LEFT JOIN (SELECT x, count(*) AS k FROM (SELECT src AS x FROM live UNION ALL SELECT dst FROM live) GROUP BY x) ON x=entity_id), (SELECT count(*) AS ed, sum(CASE WHEN src=dst THEN 1 ELSE 0 END) AS sl FROM live)", "entities", "rels", recursive=LIVE)),
    "g15_closeness": (g15_closeness, v.oracle("SELECT n_name AS node, round(coalesce((r/d)*(r/((SELECT count(*) FROM nation)-1)),0),9) AS closeness FROM nation LEFT JOIN (SELECT root, count(*) AS r, sum(h) AS d FROM best WHERE h>0 GROUP BY root) ON root=n_name", "tedges", recursive=HOPS)),
    "g16_betweenness": (g16_betweenness, None),
    "g17_hops": (g17_hops, v.oracle("SELECT root, node, h AS hops FROM best WHERE h>0", "tedges", recursive=HOPS)),
    "g18_wcc": (g18_wcc, v.oracle("SELECT node, min(root) AS component FROM wr GROUP BY node", "located", recursive=WCC)),
    "g19_scc": (g19_scc, v.oracle("SELECT a.node, min(a.root) AS component FROM best a JOIN best b ON a.root=b.node AND a.node=b.root GROUP BY a.node", "tedges", recursive=HOPS)),
    "g20_articulation": (g20_articulation, None),
    "g21_topo_levels": (g21_topo_levels, v.oracle("SELECT level, count(*) AS n, min(node) AS first FROM (SELECT node, max(h) AS level FROM w GROUP BY node) GROUP BY level", "supplies", "serves", recursive="e AS (SELECT src, dst FROM supplies UNION SELECT src, dst FROM serves), w AS (SELECT src AS node, 0 AS h FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, w.h+1 FROM w JOIN e ON e.src=w.node)")),
    "g22_max_flow": (g22_max_flow, None),
    "g24_snapshot": (g24_snapshot, v.oracle("SELECT entity_type AS kind, count(*) AS n FROM entities GROUP BY 1 UNION ALL SELECT kind, count(*) FROM live GROUP BY kind", "entities", "rels", recursive=LIVE)),
    "g25_remove": (g25_remove, v.oracle("SELECT kind, count(*) AS n FROM rels WHERE src NOT IN (SELECT x FROM gone) AND dst NOT IN (SELECT x FROM gone) GROUP BY kind", "rels", recursive="gone AS (SELECT 'part:'||p_partkey AS x FROM part WHERE p_partkey%3=0)")),
    "g27_edge_score": (g27_edge_score, v.oracle("SELECT node, round(max(pow(raw,0.5)),9) AS geometric_mean FROM p GROUP BY node", "supplies", "serves", recursive=TWO)),
    "s01_merge": (s01_merge, v.oracle("SELECT count(*) AS relationships, sum(CASE WHEN relationship_id LIKE '%7' AND strength<>0.5 THEN 1 ELSE 0 END)::BIGINT AS collisions FROM supplies", "supplies")),
    "j12_bitemporal_traverse": (j12_bitemporal_traverse, v.oracle(f"SELECT DISTINCT node FROM (SELECT dst AS node FROM supplies WHERE {ON} AND src='{ROOT}' UNION SELECT v.dst FROM supplies s JOIN serves v ON s.dst=v.src WHERE s.src='{ROOT}' AND {ON.replace('valid_', 's.valid_')} AND {ON.replace('valid_', 'v.valid_')} AND v.valid_from + INTERVAL 3 DAY <= TIMESTAMP '{v.AT}')", "supplies", "serves")),
}
