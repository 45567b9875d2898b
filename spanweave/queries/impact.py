"""Queries of propagation, continuity, scenarios and counterfactuals."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from .. import views as v
from ..operators import propagation as p


def edges(s, d, of=None):
    """Edges of suppliers and parts: all, or those that leave the entities ``of`` (src), which are few."""
    both = v.supplies(s, d, of).unionByName(v.serves(s, d, of))
    return both.select(F.col("relationship_id").alias("edge_id"), "src", "dst", (F.col("strength") * F.col("capacity")).alias("factor"), "valid_from", "valid_to")


def signals(s, d):
    return p.propagate(partial(edges, s, d), v.shocks(s, d))


def p01_propagate(s, d):
    return signals(s, d).select("shock_id", "entity", F.round("impairment", 9).alias("impairment"), "depth", F.array_join("path", ">").alias("path"))


def _bounded(s, d):
    return p.propagate_bounded(partial(edges, s, d), v.shocks(s, d), max_signals=40, paths_an_entity=2)


def p01_bounded(s, d):
    """Signals of a run that keeps two paths an entity and stops after 40 signals."""
    return _bounded(s, d)[0].select("shock_id", "entity", F.round("impairment", 9).alias("impairment"), "depth", F.array_join("path", ">").alias("path"))


def p01_outcome(s, d):
    """How that run ended, beside what it generated at each depth."""
    signals, ended = _bounded(s, d)
    return signals.groupBy("depth").agg(F.count("*").alias("n")).select("depth", "n", F.lit(ended.status).alias("status"), F.lit(ended.reason).alias("reason"), F.lit(ended.processed).cast("long").alias("processed"), F.lit(ended.generated).cast("long").alias("generated"))


def p03_edge_factor(s, d):
    f = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("strength") * F.col("capacity")))
    rows = v.supplies(s, d).select(F.when(f < 0.01, 0.0).otherwise(f).alias("f"))
    return rows.groupBy(F.round("f", 1).alias("factor")).agg(F.count("*").alias("n"))


def p06_attenuation(s, d):
    """Interventions protect nations' customers: reductions from two programmes, merged by the larger."""
    c = v.table(s, d, "customer")
    one = c.select(F.concat(F.lit("customer:"), "c_custkey").alias("entity"), F.round(F.pmod("c_nationkey", F.lit(5)) / 10, 6).alias("reduction"), F.lit(0.0).alias("gain"))
    two = c.where("c_acctbal > 5000").select(F.concat(F.lit("customer:"), "c_custkey").alias("entity"), F.lit(0.25).alias("reduction"), F.lit(0.1).alias("gain"))
    return p.attenuation(one.unionByName(two)).groupBy(F.round("keep", 9).alias("keep")).agg(F.count("*").alias("n"))


def _capacity(how):
    def run(s, d):
        return p.capacities(signals(s, d), how).select("entity", F.round("impairment", 9).alias("impairment"), "n", F.round(1 - F.col("impairment"), 9).alias("capacity"))

    return run


def w01_strongest(s, d):
    return p.strongest(signals(s, d)).select("entity", F.round("impairment", 9).alias("impairment"), "depth", F.array_join("path", ">").alias("path"))


def k01_top_k(s, d):
    return signals(s, d).where("depth > 0").select(F.round("impairment", 9).alias("impairment"), "depth", "entity", F.array_join("path", ">").alias("path")).orderBy(F.desc("impairment"), "depth", "entity", "path").limit(15)


def k02_critical_paths(s, d):
    return signals(s, d).select(F.round(F.col("impairment") / (F.col("depth") + 1), 9).alias("influence"), F.array_join("path", ">").alias("path")).orderBy(F.desc("influence"), "path").limit(15)


def a03_group_by_entity(s, d):
    return signals(s, d).groupBy("entity").agg(F.array_join(F.sort_array(F.collect_set("shock_id")), ",").alias("shocks"), F.count("*").alias("n"))


def a09_evidence_counts(s, d):
    return signals(s, d).groupBy(F.when(F.col("depth") == 0, "source").otherwise("propagated").alias("method")).agg(F.count("*").alias("n"))


def w02_evidence_rank(s, d):
    from pyspark.sql import Window

    per = p.capacities(signals(s, d)).withColumn("impairment", F.round("impairment", 9))
    return per.select(F.row_number().over(Window.orderBy(F.desc("impairment"), "entity")).cast("long").alias("place"), "entity", "impairment")


def _impaired(s, d):
    return p.capacities(signals(s, d)).select("entity", "impairment")


METRICS = ["least", "hours_below", "capacity_hours", "deficit_hours", "resilience"]


def c01_continuity(s, d):
    out = p.continuity(p.trajectory(_impaired(s, d), 24, 48, 7), 0.9)
    return out.select("entity", *[F.round(c, 6).alias(c) for c in METRICS])


def c02_recovery(s, d):
    return p.trajectory(_impaired(s, d), 24, 48, 7).select("entity", F.round("hour", 6).alias("hour"), F.round("capacity", 7).alias("capacity"))


def w09_time_to_threshold(s, d):
    pts = p.trajectory(_impaired(s, d), 24, 48, 7).where("hour >= 24")
    return pts.groupBy("entity").agg(F.round(F.min(F.when(F.col("capacity") >= 0.9, F.col("hour"))), 6).alias("hour"))


def c03_substitution(s, d):
    rows = _impaired(s, d)
    return rows.select("entity", F.round(F.least(F.lit(1.0), (1 - F.col("impairment")) + F.col("impairment") * 0.5 * 0.8 * 0.9), 9).alias("capacity"))


def _worlds(s, d):
    """Two worlds, with and without the interventions, in one plan."""
    sh = v.shocks(s, d).withColumn("world", F.explode(F.array(F.lit("baseline"), F.lit("protected"))))
    keep = v.table(s, d, "part").where("p_partkey % 2 = 0").select(F.lit("protected").alias("world"), F.concat(F.lit("part:"), "p_partkey").alias("entity"), F.lit(0.5).alias("keep"))
    return p.propagate(partial(edges, s, d), sh, keep, variant=["world"])


def cf01_compare(s, d):
    per = p.capacities(_worlds(s, d), by=["world"])
    wide = per.groupBy("entity").agg(F.coalesce(F.max(F.when(F.col("world") == "baseline", F.col("impairment"))), F.lit(0.0)).alias("b"), F.coalesce(F.max(F.when(F.col("world") == "protected", F.col("impairment"))), F.lit(0.0)).alias("c"))
    return wide.select("entity", F.round(1 - F.col("b"), 9).alias("baseline"), F.round(1 - F.col("c"), 9).alias("protected"), F.round(F.col("b") - F.col("c"), 9).alias("gain"), F.round(p.change(1 - F.col("b"), 1 - F.col("c")), 9).alias("relative"))


def cf02_run_many(s, d):
    """Each of five interventions halves what reaches a fifth of the parts; they are ranked by the capacity gained."""
    many = s.range(5).select(F.col("id").alias("world"))
    sh = v.shocks(s, d).crossJoin(F.broadcast(many))
    keep = v.table(s, d, "part").select(F.pmod("p_partkey", F.lit(5)).cast("long").alias("world"), F.concat(F.lit("part:"), "p_partkey").alias("entity"), F.lit(0.5).alias("keep"))
    per = p.capacities(p.propagate(partial(edges, s, d), sh, keep, variant=["world"]), by=["world"])
    base = p.capacities(signals(s, d)).select("entity", F.col("impairment").alias("base"))
    gain = base.crossJoin(F.broadcast(many)).join(per.select("world", "entity", "impairment"), ["world", "entity"], "left").groupBy("world").agg(F.round(F.sum(F.col("base") - F.coalesce("impairment", F.lit(0.0))), 6).alias("gain"))
    from pyspark.sql import Window

    return gain.select("world", "gain", F.row_number().over(Window.orderBy(F.desc("gain"), "world")).cast("long").alias("place"))


def _patches(s, d):
    n = v.table(s, d, "nation")
    name = F.col("n_name").alias("entity")
    a = n.select(name, F.lit(1).alias("seq"), F.lit("multiply").alias("op"), F.round(1 - F.pmod("n_nationkey", F.lit(4)) / 10, 6).alias("amount"))
    b = n.where("n_nationkey % 3 = 0").select(name, F.lit(2).alias("seq"), F.lit("set").alias("op"), F.lit(0.6).alias("amount"))
    c = n.select(name, F.lit(3).alias("seq"), F.lit("add").alias("op"), F.lit(0.15).alias("amount"))
    e = n.where("n_regionkey = 1").select(name, F.lit(4).alias("seq"), F.lit("min").alias("op"), F.lit(0.7).alias("amount"))
    f = n.where("n_regionkey = 2").select(name, F.lit(5).alias("seq"), F.lit("max").alias("op"), F.lit(0.95).alias("amount"))
    return a.unionByName(b).unionByName(c).unionByName(e).unionByName(f)


def sc01_apply(s, d):
    return p.fold_patches(_patches(s, d)).select("entity", F.round("capacity", 9).alias("capacity"))


def sc02_compose(s, d):
    more = _patches(s, d).withColumn("seq", F.col("seq") + 10)
    return p.fold_patches(_patches(s, d).unionByName(more)).select("entity", F.round("capacity", 9).alias("capacity"))


def s02_state_diff(s, d):
    a = p.fold_patches(_patches(s, d).where("seq < 4")).select("entity", F.round("capacity", 9).alias("a")).where("entity not like '%1'")
    b = p.fold_patches(_patches(s, d)).select("entity", F.round("capacity", 9).alias("b")).where("entity not like '%2'")
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return a.join(b, "entity", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("entity", kind.alias("kind"), F.round(F.col("b") - F.col("a"), 9).alias("delta"))


def f12_guards(s, d):
    state = p.fold_patches(_patches(s, d))
    rules = s.createDataFrame([("lt", 0.7), ("ge", 0.9), ("eq", 0.75), ("ne", 0.75)], "op string, bound double")
    x, y = F.round("capacity", 9), F.col("bound")
    hit = F.when(F.col("op") == "lt", x < y).when(F.col("op") == "ge", x >= y).when(F.col("op") == "eq", x == y).otherwise(x != y)
    return state.crossJoin(F.broadcast(rules)).groupBy("op").agg(F.sum(hit.cast("int")).alias("n"))


def f19_active_shocks(s, d):
    sh = v.shocks(s, d).withColumn("ends_at", F.col("starts_at") + F.make_dt_interval(F.pmod(F.regexp_extract("source", r"(\d+)", 1).cast("int"), F.lit(9)).cast("int")))
    at = F.lit("1998-01-04 00:00:00").cast("timestamp_ntz")
    return sh.where((F.col("starts_at") <= at) & (at < F.col("ends_at"))).select("shock_id", "ends_at")


ON = "(e.valid_from IS NULL OR e.valid_from <= TIMESTAMP '1998-01-01') AND (e.valid_to IS NULL OR TIMESTAMP '1998-01-01' < e.valid_to)"


def _walk(worlds: str = "", keep: str = "1.0", key: str = "") -> str:
    w = f"{key}, " if key else ""
    k = f"s.{key}, " if key else ""
    return f"""ed AS (SELECT src, dst, strength*capacity AS factor, valid_from, valid_to FROM supplies UNION ALL SELECT src, dst, strength*capacity, valid_from, valid_to FROM serves),
 sg AS (SELECT {w}shock_id, source AS entity, severity AS impairment, 0 AS depth, [source] AS path FROM shocks{worlds} UNION ALL
 SELECT {k}s.shock_id, e.dst, s.impairment*least(1.0,greatest(0.0,e.factor))*{keep}, s.depth+1, list_append(s.path, e.dst) FROM sg s JOIN ed e ON e.src=s.entity
 WHERE NOT list_contains(s.path, e.dst) AND {ON} AND s.impairment*least(1.0,greatest(0.0,e.factor))*{keep} >= 0.01 AND s.depth<32)"""


_STEP = "least(1.0,greatest(0.0,e.strength*e.capacity))"
_QUEUE = f"""d0 AS (SELECT shock_id, source AS entity, severity AS impairment, 0 AS depth, source AS path, row_number() OVER (PARTITION BY source ORDER BY shock_id) AS k FROM shocks),
 p0 AS (SELECT *, row_number() OVER (ORDER BY shock_id, entity) AS place FROM d0 WHERE k<=2),
 d1 AS (SELECT p.shock_id, e.dst AS entity, p.impairment*{_STEP} AS impairment, 1 AS depth, p.path||'>'||e.dst AS path, e.relationship_id AS r1, row_number() OVER (PARTITION BY e.dst ORDER BY p.place, e.relationship_id) AS k FROM p0 p JOIN supplies e ON e.src=p.entity WHERE p.place<=40 AND {ON} AND e.strength*e.capacity>0 AND p.impairment*{_STEP}>=0.01),
 p1 AS (SELECT *, (SELECT count(*) FROM p0)+row_number() OVER (ORDER BY shock_id, entity, r1) AS place FROM d1 WHERE k<=2),
 d2 AS (SELECT p.shock_id, e.dst AS entity, p.impairment*{_STEP} AS impairment, 2 AS depth, p.path||'>'||e.dst AS path, row_number() OVER (PARTITION BY e.dst ORDER BY p.place, e.relationship_id) AS k FROM p1 p JOIN serves e ON e.src=p.entity WHERE p.place<=40 AND {ON} AND e.strength*e.capacity>0 AND p.impairment*{_STEP}>=0.01),
 qs AS (SELECT shock_id, entity, impairment, depth, path FROM p0 UNION ALL SELECT shock_id, entity, impairment, depth, path FROM p1 UNION ALL SELECT shock_id, entity, impairment, depth, path FROM d2 WHERE k<=2)"""
SG = _walk()
BASE = ("supplies", "serves", "shocks")
IMP = ", im AS (SELECT entity, max(impairment) AS i FROM sg GROUP BY entity)"
TRAJ = IMP + ", tr AS (SELECT entity, h AS hour, 1-i*(1-f) AS capacity FROM im, (SELECT 0.0::DOUBLE AS h, 0.0::DOUBLE AS f UNION ALL SELECT 24.0, 0.0 UNION ALL SELECT 24.0+48.0*g/7, g/7.0::DOUBLE FROM generate_series(1,7) t(g)))"
PATCH = """pt AS (SELECT n_name AS entity, 1 AS seq, 'multiply' AS op, round(1-(n_nationkey%4)/10,6)::DOUBLE AS amount FROM nation UNION ALL SELECT n_name,2,'set',0.6 FROM nation WHERE n_nationkey%3=0 UNION ALL SELECT n_name,3,'add',0.15 FROM nation
 UNION ALL SELECT n_name,4,'min',0.7 FROM nation WHERE n_regionkey=1 UNION ALL SELECT n_name,5,'max',0.95 FROM nation WHERE n_regionkey=2)"""


def _fold(source: str, name: str) -> str:
    return f"""{name}_o AS MATERIALIZED (SELECT entity, op, amount, row_number() OVER (PARTITION BY entity ORDER BY seq) AS k FROM {source}), {name}_r AS (SELECT DISTINCT entity, 0::BIGINT AS k, 1.0::DOUBLE AS c FROM {name}_o UNION ALL
 SELECT r.entity, o.k, least(1.0, greatest(0.0, CASE o.op WHEN 'set' THEN o.amount WHEN 'add' THEN r.c+o.amount WHEN 'multiply' THEN r.c*o.amount WHEN 'min' THEN least(r.c,o.amount) ELSE greatest(r.c,o.amount) END)) FROM {name}_r r JOIN {name}_o o ON o.entity=r.entity AND o.k=r.k+1), {name} AS (SELECT entity, arg_max(c, k) AS capacity FROM {name}_r GROUP BY entity)"""


QUERIES = {
    "p01_bounded": (p01_bounded, v.oracle("SELECT shock_id, entity, round(impairment,9) AS impairment, depth, path FROM qs", *BASE, recursive=_QUEUE)),
    "p01_outcome": (p01_outcome, v.oracle("SELECT depth, count(*) AS n, CASE WHEN cut OR full_ THEN 'truncated' ELSE 'complete' END AS status, CASE WHEN cut THEN 'max_signals reached' WHEN full_ THEN 'max_paths_per_entity reached' ELSE 'quiescent' END AS reason, least(40, every) AS processed, every AS generated FROM qs, (SELECT (SELECT count(*) FROM qs) AS every, (SELECT count(*) FROM qs)>40 AS cut, (SELECT bool_or(k>2) FROM (SELECT k FROM d0 UNION ALL SELECT k FROM d1 UNION ALL SELECT k FROM d2)) AS full_) GROUP BY ALL", *BASE, recursive=_QUEUE)),
    "p01_propagate": (p01_propagate, v.oracle("SELECT shock_id, entity, round(impairment,9) AS impairment, depth, array_to_string(path,'>') AS path FROM sg", *BASE, recursive=SG)),
    "p03_edge_factor": (p03_edge_factor, v.oracle("SELECT round(CASE WHEN f<0.01 THEN 0 ELSE f END,1) AS factor, count(*) AS n FROM (SELECT least(1.0,greatest(0.0,strength*capacity)) AS f FROM supplies) GROUP BY 1", "supplies")),
    "p06_attenuation": (p06_attenuation, "SELECT round((1-greatest((c_nationkey%5)/10, CASE WHEN c_acctbal>5000 THEN 0.25 ELSE 0 END))*(1-CASE WHEN c_acctbal>5000 THEN 0.1 ELSE 0 END),9)::DOUBLE AS keep, count(*) AS n FROM customer GROUP BY 1"),
    "p07_sum_cap": (_capacity("sum_cap"), v.oracle("SELECT entity, round(least(1.0,sum(impairment)),9) AS impairment, count(*) AS n, round(1-least(1.0,sum(impairment)),9) AS capacity FROM sg GROUP BY entity", *BASE, recursive=SG)),
    "p07_noisy_or": (_capacity("noisy_or"), v.oracle("SELECT entity, round(1-product(1-impairment),9) AS impairment, count(*) AS n, round(product(1-impairment),9) AS capacity FROM sg GROUP BY entity", *BASE, recursive=SG)),
    "a01_max": (_capacity("max"), v.oracle("SELECT entity, round(max(impairment),9) AS impairment, count(*) AS n, round(1-max(impairment),9) AS capacity FROM sg GROUP BY entity", *BASE, recursive=SG)),
    "w01_strongest": (w01_strongest, v.oracle("SELECT entity, round(impairment,9) AS impairment, depth, array_to_string(path,'>') AS path FROM sg QUALIFY row_number() OVER (PARTITION BY entity ORDER BY impairment DESC, depth, path)=1", *BASE, recursive=SG)),
    "k01_top_k": (k01_top_k, v.oracle("SELECT round(impairment,9) AS impairment, depth, entity, array_to_string(path,'>') AS path FROM sg WHERE depth>0 ORDER BY 1 DESC, 2, 3, 4 LIMIT 15", *BASE, recursive=SG)),
    "k02_critical_paths": (k02_critical_paths, v.oracle("SELECT round(impairment/(depth+1),9) AS influence, array_to_string(path,'>') AS path FROM sg ORDER BY 1 DESC, 2 LIMIT 15", *BASE, recursive=SG)),
    "a03_group_by_entity": (a03_group_by_entity, v.oracle("SELECT entity, string_agg(DISTINCT shock_id, ',' ORDER BY shock_id) AS shocks, count(*) AS n FROM sg GROUP BY entity", *BASE, recursive=SG)),
    "a09_evidence_counts": (a09_evidence_counts, v.oracle("SELECT CASE WHEN depth=0 THEN 'source' ELSE 'propagated' END AS method, count(*) AS n FROM sg GROUP BY 1", *BASE, recursive=SG)),
    "w02_evidence_rank": (w02_evidence_rank, v.oracle("SELECT row_number() OVER (ORDER BY round(i,9) DESC, entity) AS place, entity, round(i,9) AS impairment FROM im", *BASE, recursive=SG + IMP)),
    "c01_continuity": (c01_continuity, v.oracle("""SELECT entity, round(min(a),6) AS least, round(coalesce(sum(CASE WHEN a<0.9 AND b<0.9 THEN dt WHEN a<0.9 AND b>=0.9 THEN dt*(0.9-a)/(b-a) WHEN a>=0.9 AND b<0.9 THEN dt*(0.9-b)/(a-b) ELSE 0 END),0),6) AS hours_below, round(sum(dt*(a+b)/2),6) AS capacity_hours,
 round(sum(dt*greatest(0.0,1-(a+b)/2)),6) AS deficit_hours, round(sum(dt*(a+b)/2)/sum(dt),6) AS resilience FROM (SELECT entity, capacity AS a, lead(capacity) OVER w AS b, lead(hour) OVER w - hour AS dt FROM tr WINDOW w AS (PARTITION BY entity ORDER BY hour, capacity)) GROUP BY entity""", *BASE, recursive=SG + TRAJ)),
    "c02_recovery": (c02_recovery, v.oracle("SELECT entity, round(hour,6) AS hour, round(capacity,7) AS capacity FROM tr", *BASE, recursive=SG + TRAJ)),
    "w09_time_to_threshold": (w09_time_to_threshold, v.oracle("SELECT entity, round(min(CASE WHEN capacity>=0.9 THEN hour END),6) AS hour FROM tr WHERE hour>=24 GROUP BY entity", *BASE, recursive=SG + TRAJ)),
    "c03_substitution": (c03_substitution, v.oracle("SELECT entity, round(least(1.0,(1-i)+i*0.5*0.8*0.9),9) AS capacity FROM im", *BASE, recursive=SG + IMP)),
    "cf01_compare": (cf01_compare, v.oracle("SELECT entity, round(1-b,9) AS baseline, round(1-c,9) AS protected, round(b-c,9) AS gain, round(CASE WHEN b=1 AND c=1 THEN 0 WHEN b=1 THEN 'inf'::DOUBLE ELSE ((1-c)-(1-b))/(1-b) END,9) AS relative FROM (SELECT entity, coalesce(max(CASE WHEN world='baseline' THEN impairment END),0) AS b, coalesce(max(CASE WHEN world='protected' THEN impairment END),0) AS c FROM sg GROUP BY entity)", *BASE, recursive=_walk(" , (SELECT unnest(['baseline','protected']) AS world)", "(CASE WHEN s.world='protected' AND e.dst LIKE 'part:%' AND CAST(split_part(e.dst,':',2) AS INT)%2=0 THEN 0.5 ELSE 1.0 END)", "world"))),
    "cf02_run_many": (cf02_run_many, v.oracle("SELECT world, gain, row_number() OVER (ORDER BY gain DESC, world) AS place FROM (SELECT w.world, round(sum(b.i - coalesce(x.i,0)),6) AS gain FROM (SELECT entity, max(impairment) AS i FROM sg WHERE world=-1 GROUP BY entity) b CROSS JOIN (SELECT unnest(range(5)) AS world) w LEFT JOIN (SELECT world, entity, max(impairment) AS i FROM sg GROUP BY ALL) x ON x.world=w.world AND x.entity=b.entity GROUP BY w.world)", *BASE, recursive=_walk(" , (SELECT unnest(range(-1,5)) AS world)", "(CASE WHEN s.world>=0 AND e.dst LIKE 'part:%' AND CAST(split_part(e.dst,':',2) AS INT)%5=s.world THEN 0.5 ELSE 1.0 END)", "world"))),
    "sc01_apply": (sc01_apply, v.oracle("SELECT entity, round(capacity,9) AS capacity FROM st", recursive=PATCH + ", " + _fold("pt", "st"))),
    "sc02_compose": (sc02_compose, v.oracle("SELECT entity, round(capacity,9) AS capacity FROM st", recursive=PATCH + ", pp AS (SELECT * FROM pt UNION ALL SELECT entity, seq+10, op, amount FROM pt), " + _fold("pp", "st"))),
    "s02_state_diff": (s02_state_diff, v.oracle("SELECT coalesce(x.entity,y.entity) AS entity, CASE WHEN x.entity IS NULL THEN 'added' WHEN y.entity IS NULL THEN 'removed' ELSE 'changed' END AS kind, round(round(y.capacity,9)-round(x.capacity,9),9) AS delta FROM (SELECT * FROM sa WHERE entity NOT LIKE '%1') x FULL JOIN (SELECT * FROM sb WHERE entity NOT LIKE '%2') y ON x.entity=y.entity WHERE round(x.capacity,9) IS DISTINCT FROM round(y.capacity,9)", recursive=PATCH + ", p3 AS (SELECT * FROM pt WHERE seq<4), " + _fold("p3", "sa") + ", " + _fold("pt", "sb"))),
    "f12_guards": (f12_guards, v.oracle("SELECT op, sum(CASE WHEN (op='lt' AND c<b) OR (op='ge' AND c>=b) OR (op='eq' AND c=b) OR (op='ne' AND c<>b) THEN 1 ELSE 0 END)::BIGINT AS n FROM (SELECT round(capacity,9) AS c FROM st), (VALUES ('lt',0.7::DOUBLE),('ge',0.9),('eq',0.75),('ne',0.75)) t(op,b) GROUP BY op", recursive=PATCH + ", " + _fold("pt", "st"))),
    "f19_active_shocks": (f19_active_shocks, v.oracle("SELECT shock_id, ends_at FROM (SELECT shock_id, starts_at, starts_at + to_days(CAST(split_part(source,':',2) AS INT)%9) AS ends_at FROM shocks) WHERE starts_at <= TIMESTAMP '1998-01-04' AND TIMESTAMP '1998-01-04' < ends_at", "shocks")),
}
