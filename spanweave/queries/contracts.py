"""Queries of guards, rounding, timestamps, units, samples, validated records, run records, polygons and features."""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import views as v
from ..functions import scalars as sc
from ..operators import sampling as sa
from ..operators import evidence as ev
from ..operators import propagation as p
from ..operators import spatial as sp
from ..operators import stats as st
from ..operators import temporal as t
from ..plans.lineage import shared_folder
from ..sources import formats
from . import impact
from .temporal import ALLEN


def f12_all_guards(s, d):
    """Every comparison, on balances of which some are null."""
    rules = s.createDataFrame([("lt", 0.0), ("le", 711.56), ("ge", 5000.0), ("gt", 711.56), ("eq", 711.56), ("ne", 711.56)], "op string, bound double")
    rows = v.table(s, d, "customer").select(F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("x"))
    return rows.crossJoin(F.broadcast(rules)).groupBy("op").agg(F.sum(sc.guard_holds(F.col("x"), F.col("op"), F.col("bound")).cast("long")).alias("n"))


def f13_by_entity(s, d):
    """Lines as evidence on a supplier, a part and an order: those on one entity."""
    about = {"supplier": "l_suppkey", "part": "l_partkey", "order": "l_orderkey"}
    return ev.by_entity(v.table(s, d, "lineitem"), about, "supplier:3").select("l_orderkey", "l_linenumber")


def f13_containing(s, d):
    return v.intervals(s, d).where(t.active_at(t.instant(v.AT), "s", "e")).select("id", "s", "e")


def f13_by_digest(s, d):
    """Documents by digest: each text's ids, counted."""
    wanted = v.table(s, d, "documents").where("doc_id % 100 = 0").select(F.sha2("text", 256).alias("digest")).distinct()
    return v.table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest")).join(wanted, "digest").groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def a11_confidence(s, d):
    rows = v.table(s, d, "events").select("event_id", F.col("user_id").alias("subject"), F.col("event_type").alias("attribute"), F.round("value", 0).alias("value"), (F.col("event_id") % 5 / 5).alias("confidence"), F.floor(F.col("event_id") / 3).alias("evidence_id"))
    return st.fuse(rows, "subject", "event_id").select("subject", "attributes", F.round("conflict", 6).alias("conflict"), F.round("confidence", 6).alias("confidence"), "evidence")


def a17_dominance(s, d):
    return st.dominance(v.table(s, d, "part"), ["p_brand"], "p_retailprice").select("p_brand", F.round("dominance", 9).alias("dominance"))


def t04_inverse(s, d):
    """The relation of each interval with the next of its owner, and the inverse."""
    w = Window.partitionBy("owner").orderBy("id")
    rows = v.intervals(s, d).select("s", "e", F.lead("s").over(w).alias("s2"), F.lead("e").over(w).alias("e2")).where("s2 is not null")
    relation = t.allen(F.col("s"), F.col("e"), F.col("s2"), F.col("e2"))
    return rows.groupBy(relation.alias("relation"), sc.allen_inverse(relation).alias("inverse")).agg(F.count("*").alias("n"))


def t12_parse(s, d):
    """Timestamps with Z, offsets and long fractions, read; malformed ones are null."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.pmod("event_id", F.lit(7))
    form = (
        F.when(k == 0, F.concat(text, F.lit("Z"))).when(k == 1, F.concat(text, F.lit(".1234567+05:30"))).when(k == 2, F.concat(F.lit(" "), F.regexp_replace(text, "T", "t"), F.lit("-08:00 ")))
        .when(k == 3, F.concat(text, F.lit("+24:00"))).when(k == 4, text).when(k == 5, F.concat(F.lit("2021-02-30"), F.substring(text, 11, 9), F.lit("Z"))).otherwise(F.concat(text, F.lit(".5Z")))
    )
    return v.table(s, d, "events").select("event_id", sc.parse_rfc3339(form).alias("at"))


def m03_eight_modes(s, d):
    """Eighths of prices with both signs, to cents, in each mode; sums by flag, in cents."""
    sign = F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)
    x = (sign * F.round(F.col("l_extendedprice") * 100).cast("decimal(18,0)") * 125 / 100000).cast("decimal(24,5)")
    return v.table(s, d, "lineitem").groupBy("l_returnflag").agg(*[F.sum((sc.quantize(x, 2, m) * 100).cast("long")).alias(f"m_{m}") for m in sc.ROUNDINGS])


EXPRESSIONS = ("kg*m/s^2", "m / s", "MW", "kWh/h", "km^2", "kg*q", "m**s", "1/s")


def u01_expressions(s, d):
    """Sizes in units given as expressions, in SI, with their dimension; null where an expression can't be read."""
    given = s.createDataFrame(list(enumerate(EXPRESSIONS)), "k long, text string")
    units = given.select("k", sc.parse_units(F.col("text")).alias("unit"))  # each expression is read once, not once a part
    rows = v.table(s, d, "part").select("p_partkey", "p_size", (F.col("p_partkey") % len(EXPRESSIONS)).alias("k"))
    return rows.join(F.broadcast(units), "k", "left").select("p_partkey", F.round(F.col("p_size") * F.col("unit.scale"), 6).alias("si"), F.col("unit.dimension").alias("dimension"))


def n03_latin(s, d):
    """A Latin hypercube of the suppliers: one in each row and column of as many cells."""
    found = sa.latin_hypercube(v.table(s, d, "supplier").select(F.col("s_suppkey").alias("id")), "id", ["x", "y"])
    return found.select("id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


def x02_normalize_iri(s, d):
    """URLs with white space collapsed that are absolute IRIs; null else."""
    text = ev.collapse(F.concat(F.lit(" "), "url", F.when(F.col("page_id") % 9 == 0, F.lit(" x")).otherwise(F.lit("\t"))))
    return v.table(s, d, "pages").select("page_id", F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"), text).alias("iri"))


def io07_store(s, d):
    """Texts in a store by digest, of which every 50th was altered; the store tells which are not intact."""
    path = shared_folder(s, "objects")
    rows = v.table(s, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first"), F.first("text").alias("content"))
    formats.put_objects(rows.select("digest", F.when(F.col("first") % 50 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("content")), path)
    return formats.verify_objects(s, path)


def io10_result_tables(s, d):
    """Signals of a run as a table, written and read again."""
    path = shared_folder(s, "events")
    formats.write_rows(impact.signals(s, d).select("shock_id", F.col("entity").alias("entity_id"), F.round("impairment", 9).alias("impairment"), "depth", "effective_at"), path)
    return s.read.parquet(path)


def io11_states(s, d):
    """States as lines of JSON, written and read again."""
    path = shared_folder(s, "states")
    formats.write_json(p.fold_patches(impact._patches(s, d)).select("entity", F.struct(F.round("capacity", 6).alias("capacity")).alias("state")), path)
    return s.read.schema("entity string, state struct<capacity double>").json(path).select("entity", "state.capacity")


def io19_gnss(s, d):
    """Observations that break a rule of theirs: epoch, station, satellite, finite values."""
    e = v.table(s, d, "events")
    epoch = F.unix_seconds(F.col("ts").cast("timestamp")) - F.when(F.col("event_id") % 11 == 0, 4 * 10**9).otherwise(0)
    rules = {"epoch": epoch >= 0, "satellite": F.length(F.when(F.col("user_id") % 13 == 0, "").otherwise(F.concat(F.lit("G"), F.col("user_id") % 32))) > 0, "observable": F.when(F.col("event_id") % 17 == 0, F.lit(None)).otherwise(~F.isnan("value"))}
    return e.groupBy(sc.violations(rules).alias("broken")).agg(F.count("*").alias("n"))


def io23_assignments(s, d):
    """Lines that assign a credential, what follows its name redacted, with the digest of the whole text."""
    docs = v.table(s, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\nAPI_KEY = abc"), "doc_id", F.lit("\nmy password: x\npasswords = y")).alias("text"))
    return ev.credential_lines(docs).select("doc_id", "line", F.sha2("redacted", 256).alias("redacted"), "digest")


def p05_rules(s, d):
    """Relationships by kind: whether the rules let them pass, and the factors that they would have."""
    rules = p.Rules(kinds=("supplies", "member_of"), least_factor=0.2)
    factor = F.round(F.sum(rules.factor(F.col("strength"), F.col("capacity"), F.when(F.col("kind") == "supplies", F.lit(0.5)))), 3)
    return v.relationships(s, d).groupBy("kind", rules.allows(F.col("kind")).alias("allowed")).agg(F.count("*").alias("n"), factor.alias("factor"))


def p08_outcome(s, d):
    return p.outcome(p.Rules(hops=8).run(partial(impact.edges, s, d), v.shocks(s, d))).withColumn("impairment", F.round("impairment", 9))


def sc03_runs(s, d):
    """Records of two scenario runs: entities, those changed from the base, digest of the end state."""
    some = p.fold_patches(impact._patches(s, d).where("seq < 4")).withColumn("scenario", F.lit("first"))
    every = p.fold_patches(impact._patches(s, d)).withColumn("scenario", F.lit("all"))
    states = some.unionByName(every).withColumn("capacity", F.round("capacity", 6))
    changed = states.groupBy("scenario").agg(F.sum((F.col("capacity") != 1.0).cast("long")).alias("changed"))
    return p.state_digest(states, ["scenario"]).join(changed, "scenario")


def sc05_remove(s, d):
    """Patches of which the last is taken back for every fourth nation."""
    gone = v.table(s, d, "nation").where("n_nationkey % 4 = 0").select(F.col("n_name").alias("entity"), F.lit(9).alias("seq"), F.lit("remove").alias("op"), F.lit(None).cast("double").alias("amount"))
    return p.fold_patches(impact._patches(s, d).unionByName(gone)).select("entity", F.round("capacity", 9).alias("capacity"))


def _claims(s, d):
    status = F.element_at(F.array(*map(F.lit, ["observed", "modeled", "counterfactual", "inferred"])), (F.col("l_partkey") % 4 + 1).cast("int"))
    return v.table(s, d, "lineitem").select(status.alias("status"), (F.col("l_orderkey") % 3).alias("evidence"), (F.col("l_suppkey") % 5).alias("provenance"), F.col("l_discount").alias("threshold"))


def z08_claims(s, d):
    """Claims by the controls they break: evidence for what was observed, provenance for what was modelled, thresholds within (0, 1)."""
    status = F.col("status")
    rules = {"evidence": (status != "observed") | (F.col("evidence") > 0), "provenance": ~status.isin("modeled", "counterfactual") | (F.col("provenance") > 0), "threshold": (F.col("threshold") > 0) & (F.col("threshold") < 1)}
    return _claims(s, d).groupBy("status", sc.violations(rules).alias("broken")).agg(F.count("*").alias("n"))


def e04_accounts(s, d):
    """Accounts that break a rule: values from 0, period and measure not blank."""
    c = v.table(s, d, "customer")
    rules = {"value": F.col("c_acctbal") >= 0, "period": F.length(F.trim(F.when(F.col("c_custkey") % 6 != 0, F.lit("1998")).otherwise(F.lit("  ")))) > 0, "measure": F.col("c_name").isNotNull() & (F.length(F.trim("c_name")) > 0)}
    return c.select("c_custkey", sc.violations(rules).alias("broken"))


def _rings(s, d):
    """Per label a star of ten corners about the mean of its points."""
    centre = v.points(s, d).groupBy(F.col("label").alias("poly")).agg(F.round(F.avg("lat"), 2).alias("y"), F.round(F.avg("lon"), 2).alias("x"))
    corner = lambda k: F.struct((F.col("y") + F.when(k % 2 == 0, 40.123).otherwise(15.377) * F.sin(F.radians(k * 36 + 7))).alias("lat"), (F.col("x") + 1.5 * F.when(k % 2 == 0, 40.123).otherwise(15.377) * F.cos(F.radians(k * 36 + 7))).alias("lon"))
    return centre.select("poly", F.transform(F.sequence(F.lit(0), F.lit(9)), corner).alias("ring"))


def sp13_in_polygons(s, d):
    """Points in each label's star."""
    return sp.in_polygons(v.points(s, d).select("id", "lat", "lon"), _rings(s, d)).groupBy("poly").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.sum("id").alias("ids"))


def sp07_star_area(s, d):
    """Area of each star on the ellipsoid, in km2."""
    corners = _rings(s, d).select(F.col("poly").alias("group"), F.posexplode("ring").alias("place", "c")).select("group", "place", "c.lat", "c.lon")
    return sp.polygon_areas(corners).select(F.col("group").alias("poly"), F.round(F.col("area_m2") / 1e6, 2).alias("km2"))


def sp17_features(s, d):
    """Points as GeoJSON features, read again: coordinates with six digits."""
    text = sp.point_feature(F.col("id"), F.col("lat"), F.when(F.col("id") % 10 != 0, F.col("lon")), F.struct("label"))
    return v.points(s, d).select(F.col("id").alias("given"), sp.parse_points(text).alias("f")).select("given", F.col("f.id").alias("id"), F.col("f.lat").alias("lat"), F.col("f.lon").alias("lon"))


_STAR = """ctr AS (SELECT label AS poly, round(avg(lat),2) AS y, round(avg(lon),2) AS x FROM points GROUP BY 1), corner AS (SELECT poly, k, y+(CASE WHEN k%2=0 THEN 40.123 ELSE 15.377 END)::DOUBLE*sin(radians(k*36+7)) AS lat, x+1.5*(CASE WHEN k%2=0 THEN 40.123 ELSE 15.377 END)::DOUBLE*cos(radians(k*36+7)) AS lon FROM ctr, range(10) r(k)),
 edge AS (SELECT a.poly, a.lat AS ay, a.lon AS ax, b.lat AS bb, b.lon AS bx FROM corner a JOIN corner b ON a.poly=b.poly AND b.k=(a.k+1)%10)"""
_E2 = sp.E2
_Q = f"({1 - _E2!r}*(sin(radians({{y}}))/(1-{_E2!r}*pow(sin(radians({{y}})),2))-ln((1-{math.sqrt(_E2)!r}*sin(radians({{y}})))/(1+{math.sqrt(_E2)!r}*sin(radians({{y}}))))/(2*{math.sqrt(_E2)!r})))"
_HASH = "('0x'||substr(sha256({x}),1,12))::BIGINT"
_LATIN = "round((row_number() OVER (ORDER BY " + _HASH.format(x="'order:{a}:'||i") + ", i)-1+" + _HASH.format(x="'jitter:{a}:'||i") + "/281474976710656.0::DOUBLE)/count(*) OVER (),9) AS {a}"
_MODES = {
    "up": "f+(r>0)::INT", "down": "f", "ceiling": "f+(r>0 AND g>0)::INT", "floor": "f+(r>0 AND g<0)::INT", "half_up": "f+(r>=4)::INT", "half_down": "f+(r>4)::INT",
    "half_even": "f+(r>4 OR (r=4 AND f%2=1))::INT", "05up": "f+(r>0 AND f%5=0)::INT",
}
_EIGHTHS = "SELECT l_returnflag, CASE WHEN l_linenumber%2=0 THEN -1 ELSE 1 END AS g, CAST(round(l_extendedprice*100) AS BIGINT)//8 AS f, CAST(round(l_extendedprice*100) AS BIGINT)%8 AS r FROM lineitem"
_UNITS = [(1.0, "1,1,-2,0,0,0"), (1.0, "1,0,-1,0,0,0"), (1e6, "2,1,-3,0,0,0"), (1000.0, "2,1,-3,0,0,0"), (1e6, "2,0,0,0,0,0"), None, None, (1.0, "0,0,-1,0,0,0")]
_BROKEN = "concat_ws(',', {0})"
_LINES = "l AS (SELECT doc_id, sha256(coalesce(text,'')||chr(10)||'API_KEY = abc'||doc_id||chr(10)||'my password: x'||chr(10)||'passwords = y') AS digest, string_split(coalesce(text,'')||chr(10)||'API_KEY = abc'||doc_id||chr(10)||'my password: x'||chr(10)||'passwords = y', chr(10)) AS ls FROM documents), m AS (SELECT doc_id, digest, unnest(ls) AS t, unnest(range(1,len(ls)+1)) AS line FROM l)"
_CRED = r"\b(api[_-]?key|token|password|secret)\b\s*[:=].*$"

QUERIES = {
    "f12_all_guards": (f12_all_guards, "SELECT op, sum(CASE op WHEN 'eq' THEN x IS NOT DISTINCT FROM b WHEN 'ne' THEN x IS DISTINCT FROM b WHEN 'lt' THEN coalesce(x<b,false) WHEN 'le' THEN coalesce(x<=b,false) WHEN 'ge' THEN coalesce(x>=b,false) ELSE coalesce(x>b,false) END::INT)::BIGINT AS n FROM (SELECT CASE WHEN c_custkey%7<>0 THEN c_acctbal END AS x FROM customer), (VALUES ('lt',0.0::DOUBLE),('le',711.56),('ge',5000.0),('gt',711.56),('eq',711.56),('ne',711.56)) r(op,b) GROUP BY op"),
    "f13_by_entity": (f13_by_entity, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey=3"),
    "f13_containing": (f13_containing, v.oracle(f"SELECT id, s, e FROM ivals WHERE s<=TIMESTAMP '{v.AT}' AND TIMESTAMP '{v.AT}'<e", "ivals")),
    "f13_by_digest": (f13_by_digest, "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IN (SELECT text FROM documents WHERE doc_id%100=0) GROUP BY text"),
    "a11_confidence": (a11_confidence, "WITH per AS (SELECT user_id, event_type, (max(round(value))>min(round(value)))::INT AS differ FROM events GROUP BY ALL) SELECT subject, attributes, round(conflict,6) AS conflict, round(m*(1-0.5*conflict),6) AS confidence, evidence FROM (SELECT user_id AS subject, count(event_type) AS attributes, avg(coalesce(differ,0)) AS conflict FROM per GROUP BY 1) JOIN (SELECT user_id AS subject, avg(event_id%5/5::DOUBLE) AS m, count(DISTINCT event_id//3) AS evidence FROM events GROUP BY 1) USING (subject)"),
    "a17_dominance": (a17_dominance, "SELECT p_brand, round(CASE WHEN avg(p_retailprice)=0 THEN 1 ELSE min(p_retailprice)/avg(p_retailprice) END,9) AS dominance FROM part GROUP BY 1"),
    "t04_inverse": (t04_inverse, v.oracle(f"SELECT relation, {ALLEN} AS inverse, count(*) AS n FROM (SELECT {ALLEN} AS relation, b AS a, a AS b FROM (SELECT a, b FROM (SELECT {{'s': s, 'e': e}} AS a, lead({{'s': s, 'e': e}}) OVER (PARTITION BY owner ORDER BY id) AS b FROM ivals) WHERE b IS NOT NULL)) GROUP BY 1,2", "ivals")),
    "t12_parse": (t12_parse, "SELECT event_id, CASE event_id%7 WHEN 0 THEN u WHEN 1 THEN u+to_microseconds(123456)-INTERVAL 330 MINUTE WHEN 2 THEN u+INTERVAL 8 HOUR WHEN 6 THEN u+to_microseconds(500000) END AS at FROM (SELECT event_id, date_trunc('second', ts) AS u FROM events)"),
    "m03_eight_modes": (m03_eight_modes, "SELECT l_returnflag, " + ", ".join(f"sum(g*({x}))::BIGINT AS m_{m}" for m, x in _MODES.items()) + f" FROM ({_EIGHTHS}) GROUP BY 1"),
    "u01_expressions": (u01_expressions, "SELECT p_partkey, round(p_size*CASE p_partkey%8 " + " ".join(f"WHEN {i} THEN {u[0]!r}::DOUBLE" for i, u in enumerate(_UNITS) if u) + " END,6) AS si, CASE p_partkey%8 " + " ".join(f"WHEN {i} THEN '{u[1]}'" for i, u in enumerate(_UNITS) if u) + " END AS dimension FROM part"),
    "n03_latin": (n03_latin, f"SELECT i AS id, {_LATIN.replace('{a}', 'x')}, {_LATIN.replace('{a}', 'y')} FROM (SELECT s_suppkey AS i FROM supplier)"),
    "x02_normalize_iri": (x02_normalize_iri, r"SELECT page_id, CASE WHEN regexp_full_match(u, '[A-Za-z][A-Za-z0-9+.-]*:\S+') THEN u END AS iri FROM (SELECT page_id, trim(regexp_replace(url||CASE WHEN page_id%9=0 THEN ' x' ELSE '' END, '\s+', ' ', 'g')) AS u FROM pages)"),
    "io07_store": (io07_store, "SELECT sha256(text) AS digest, min(doc_id)%50<>0 AS intact FROM documents WHERE text IS NOT NULL GROUP BY text"),
    "io10_result_tables": (io10_result_tables, v.oracle("SELECT shock_id, entity AS entity_id, round(impairment,9) AS impairment, depth, TIMESTAMP '1998-01-01' AS effective_at FROM sg", *impact.BASE, recursive=impact.SG)),
    "io11_states": (io11_states, v.oracle("SELECT entity, round(capacity,6) AS capacity FROM st", recursive=impact.PATCH + ", " + impact._fold("pt", "st"))),
    "io19_gnss": (io19_gnss, "SELECT " + _BROKEN.format("CASE WHEN event_id%11=0 AND epoch(ts)<4000000000 THEN 'epoch' END, CASE WHEN user_id%13=0 THEN 'satellite' END, CASE WHEN event_id%17=0 OR value IS NULL OR isnan(value) THEN 'observable' END") + " AS broken, count(*) AS n FROM events GROUP BY 1"),
    "io23_assignments": (io23_assignments, f"WITH {_LINES} SELECT doc_id, line, sha256(regexp_replace(substr(t,1,240), '(?i){_CRED}', '\\1=<redacted>')) AS redacted, digest FROM m WHERE regexp_matches(t, '(?i){_CRED}')"),
    "p05_rules": (p05_rules, v.oracle("SELECT kind, kind IN ('supplies','member_of') AS allowed, count(*) AS n, round(sum(CASE WHEN f<0.2 THEN 0 ELSE f END),3) AS factor FROM (SELECT kind, least(1.0,greatest(0.0,strength*capacity*CASE WHEN kind='supplies' THEN 0.5::DOUBLE ELSE 1 END)) AS f FROM rels) GROUP BY 1,2", "rels")),
    "p08_outcome": (p08_outcome, v.oracle("SELECT 'complete' AS status, count(*) AS n, count(DISTINCT entity) AS entities, count(DISTINCT shock_id) AS shocks, max(depth) AS depth, round(max(impairment),9) AS impairment FROM sg WHERE depth<=8", *impact.BASE, recursive=impact.SG)),
    "sc03_runs": (sc03_runs, v.oracle("SELECT scenario, count(*) AS n, sha256(count(*)||':'||sum(" + _HASH.format(x="entity||':'||CAST(round(capacity*1000000) AS BIGINT)") + ")::HUGEINT) AS digest, sum((round(capacity,6)<>1.0)::INT)::BIGINT AS changed FROM (SELECT 'first' AS scenario, * FROM sa UNION ALL SELECT 'all', * FROM sb) GROUP BY scenario", recursive=impact.PATCH + ", p3 AS (SELECT * FROM pt WHERE seq<4), " + impact._fold("p3", "sa") + ", " + impact._fold("pt", "sb"))),
    "sc05_remove": (sc05_remove, v.oracle("SELECT entity, CASE WHEN n_nationkey%4=0 THEN 1.0::DOUBLE ELSE round(capacity,9) END AS capacity FROM st JOIN nation ON n_name=entity", recursive=impact.PATCH + ", " + impact._fold("pt", "st"))),
    "z08_claims": (z08_claims, "SELECT status, " + _BROKEN.format("CASE WHEN status='observed' AND ev=0 THEN 'evidence' END, CASE WHEN status IN ('modeled','counterfactual') AND pr=0 THEN 'provenance' END, CASE WHEN NOT coalesce(th>0 AND th<1,false) THEN 'threshold' END") + " AS broken, count(*) AS n FROM (SELECT (['observed','modeled','counterfactual','inferred'])[l_partkey%4+1] AS status, l_orderkey%3 AS ev, l_suppkey%5 AS pr, l_discount AS th FROM lineitem) GROUP BY 1,2"),
    "e04_accounts": (e04_accounts, "SELECT c_custkey, " + _BROKEN.format("CASE WHEN NOT coalesce(c_acctbal>=0,false) THEN 'value' END, CASE WHEN c_custkey%6=0 THEN 'period' END, CASE WHEN coalesce(trim(c_name),'')='' THEN 'measure' END") + " AS broken FROM customer"),
    "sp13_in_polygons": (sp13_in_polygons, v.oracle("SELECT poly, count(*) AS n, min(id) AS first, sum(id)::BIGINT AS ids FROM (SELECT poly, id FROM points JOIN edge ON (ay>lat)<>(bb>lat) AND lon<(bx-ax)*(lat-ay)/(bb-ay)+ax GROUP BY ALL HAVING count(*)%2=1) GROUP BY poly", "points", recursive=_STAR)),
    "sp07_star_area": (sp07_star_area, v.oracle(f"SELECT poly, round(abs(sum(radians(dx)*(h1+h2)/2))*{sp.A!r}*{sp.A!r}*pole/2/1000000,2) AS km2 FROM (SELECT poly, bx-ax+180-360*floor((bx-ax+180)/360)-180 AS dx, {_Q.format(y='ay')}/{_Q.format(y='90')} AS h1, {_Q.format(y='bb')}/{_Q.format(y='90')} AS h2, {_Q.format(y='90')} AS pole FROM edge) GROUP BY poly, pole", "points", recursive=_STAR)),
    "sp17_features": (sp17_features, v.oracle("SELECT id AS given, CASE WHEN id%10<>0 THEN id::VARCHAR END AS id, CASE WHEN id%10<>0 THEN round(lat,6) END AS lat, CASE WHEN id%10<>0 THEN round(lon,6) END AS lon FROM points", "points")),
}
