"""Queries of projections, sampling points, canonical JSON and money."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .. import views as v
from ..operators import canonical as ca
from ..operators import cells as ce
from ..operators import geodesy as gd
from ..operators import money as mo
from ..operators import projections as pr
from ..operators import sampling as sa
from ..plans.lineage import cut


def sp16_utm(s, d):
    """Does each point come back from its zone to a millimetre, and from the zone east of it?"""
    rows = v.points(s, d).select("id", (F.col("lat") * 84 / 90).alias("lat"), "lon")
    for name, z in (("own", pr.zone(F.col("lon"))), ("next", F.pmod(pr.zone(F.col("lon")), F.lit(60)) + 1)):
        # (Cut, so that what is asked of a projection doesn't repeat it.)
        rows = rows.withColumn("t", pr.transverse_mercator(F.col("lat"), F.col("lon"), z)).withColumn("b", pr.from_transverse_mercator(F.col("t.zone"), F.col("t.south"), F.col("t.x"), F.col("t.y")))
        rows = cut(rows)
        off = gd.inverse_of(F.col("lat"), F.col("lon"), F.col("b.lat"), F.col("b.lon")).metres
        rows = rows.withColumn(name, off < 1e-3).drop("t", "b")
    return rows.select("id", pr.zone(F.col("lon")).alias("zone"), "own", "next")


def sp16_meridian(s, d):
    """Northing of each point's latitude on the central meridian of its zone."""
    z = pr.zone(F.col("lon"))
    t = pr.transverse_mercator(F.col("lat"), pr.central(z), z)
    return v.points(s, d).select("id", t.alias("t")).select("id", F.round("t.x", 3).alias("x"), F.round("t.y", 2).alias("y"))


def sp16_mercator_back(s, d):
    back = pr.from_web_mercator(F.col("lon") * 100_000, F.col("lat") * 100_000)
    return v.points(s, d).select("id", back.alias("b")).select("id", F.round("b.lat", 7).alias("lat"), F.round("b.lon", 7).alias("lon"))


def sp19_tokens(s, d):
    """Tokens of each point's cells at levels 4, 12 and 30."""
    rows = ce.cells(v.points(s, d).select("id", "lat", "lon"))
    return rows.select("id", *[ce.token(ce.parent(F.col("cell"), k)).alias(f"t{k}") for k in (4, 12, 30)])


def sp19_nested(s, d):
    """Points in each cell of level 3, by a join on the range of numbers that it spans."""
    rows = cut(ce.cells(v.points(s, d).select("id", "lat", "lon")))
    low, high = ce.span(F.col("cell"))
    large = rows.select(ce.parent(F.col("cell"), 3).alias("cell")).distinct().select(ce.token(F.col("cell")).alias("token"), low.alias("low"), high.alias("high"), ce.parent(F.col("cell"), 0).alias("face"))
    inside = rows.withColumn("face", ce.parent(F.col("cell"), 0)).join(large, "face").where(F.col("cell").between(F.col("low"), F.col("high")))
    return inside.groupBy("token").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def n03_sobol(s, d):
    """A point of eight dimensions beside each customer."""
    index = F.col("c_custkey")
    return v.table(s, d, "customer").select("c_custkey", *[F.round(sa.sobol(index, k), 9).alias(f"x{k}") for k in range(8)])


def n03_hypercube(s, d):
    """Customers in as many rows and columns of cells, one in each."""
    return sa.latin_hypercube(v.table(s, d, "customer").select("c_custkey"), "c_custkey", ["x", "y"]).select("c_custkey", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


def z09_props(s, d):
    """Canonical form and digest of each event's properties."""
    return v.table(s, d, "events").select("event_id", ca.canonical(F.col("props")).alias("text"), ca.digest(F.col("props")).alias("digest"))


def x03_nested(s, d):
    """Canonical form of nested JSON whose keys, numbers and spaces are written in other ways by row."""
    name, key = F.regexp_replace("p_name", '["\\\\]', ""), F.col("p_partkey").cast("string")
    one = F.concat(F.lit('{ "z": ['), key, F.lit('.0, {"b":'), key, F.lit('.50 , "a":"'), name, F.lit('"}],"\\u00e9": 1e2, "a":null}'))
    two = F.concat(F.lit('{"é":100.0,"a":null,"z":['), key, F.lit(',{"a":"'), name, F.lit('","b":'), key, F.lit('.5}]}'))
    text = F.when(F.col("p_partkey") % 3 == 0, one).when(F.col("p_partkey") % 3 == 1, two).otherwise(F.concat(two, F.lit("]")))
    return v.table(s, d, "part").select("p_partkey", ca.canonical(text).alias("text"))


def x04_identity(s, d):
    return v.table(s, d, "nation").select("n_nationkey", ca.identity("nation", F.array("n_name", F.col("n_regionkey").cast("string")), 24).alias("id"))


def code(x):
    """The code of a nation's currency."""
    return F.concat(F.lit("C"), F.lpad(x.cast("string"), 2, "0"))


def rates(s, d):
    """Two quotes a nation's currency, with spread and fee."""
    n = v.table(s, d, "nation").select(F.col("n_nationkey").alias("a"))
    a = F.col("a")
    both = [n.select(code(a).alias("base"), code(to).alias("quote"), rate.cast("decimal(10,4)").alias("rate"), (a * 13 % 60).alias("spread_bps"), (a * 29 % 40).alias("fee_bps")) for to, rate in ((a * 7 % 25 + 3, 1 + a / 50), (a % 5, 2 - a / 40))]
    return both[0].where("quote < 'C25'").unionByName(both[1]).where("base <> quote")


def m01_fees(s, d):
    """Prices of orders in the currency of another nation: whether it is reached, the rate after spread and fee on each leg, and the path."""
    o = v.table(s, d, "orders").join(v.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    amounts = o.select("o_orderkey", code(F.col("c_nationkey")).alias("source"), code(F.col("o_orderkey") % 25).alias("target"), F.col("o_totalprice").cast("decimal(17,2)").alias("amount"))
    found = mo.convert(amounts, rates(s, d))
    return found.select("o_orderkey", F.array_join("path", ">").alias("path"), F.col("converted").isNotNull().alias("converted"), F.round(F.col("applied").cast("double"), 8).alias("applied"), F.when(F.col("path").isNotNull(), F.coalesce(F.size(F.filter("legs", lambda x: x.inverted)), F.lit(0))).alias("back"))


def _xor(dimension: int) -> str:
    parts = [f"CASE WHEN (g>>{k})&1=1 THEN {x} ELSE 0 END" for k, x in enumerate(sa.directions(dimension))]
    return f"round({reduce(lambda a, b: f'xor({a},{b})', parts)}/{1 << sa.BITS}.0::DOUBLE,9) AS x{dimension}"


_HASH = "('0x'||substr(sha256({x}),1,12))::BIGINT"
_CELL = "round((row_number() OVER (ORDER BY " + _HASH.format(x="'order:{a}:'||c_custkey") + ", c_custkey)-1+" + _HASH.format(x="'jitter:{a}:'||c_custkey") + "/281474976710656.0::DOUBLE)/count(*) OVER (),9) AS {a}"
_ZONE = "(floor((lon+180)/6)::BIGINT%60+1)::INTEGER"
_ARC = f"(SELECT sum((CASE WHEN j IN (0, 400) THEN 1 WHEN j%2=1 THEN 4 ELSE 2 END)*{gd.A!r}*(1-{gd.E2!r})/pow(1-{gd.E2!r}*pow(sin(radians(lat*j/400)),2),1.5))*radians(lat)/1200 FROM range(401) t(j))"
CODE = "'C'||lpad(({0})::VARCHAR,2,'0')"
RATES = f"""q AS (SELECT {CODE.format('a')} AS base, {CODE.format('b')} AS quote, rate, a*13%60 AS spread, a*29%40 AS fee FROM (SELECT n_nationkey AS a, n_nationkey*7%25+3 AS b, round((1+n_nationkey/50)::DOUBLE,4) AS rate FROM nation UNION ALL SELECT n_nationkey, n_nationkey%5, round((2-n_nationkey/40)::DOUBLE,4) FROM nation) WHERE a<>b AND b<25),
 q1 AS (SELECT base, quote, min({{'r': rate, 's': spread, 'f': fee}}) AS m FROM q GROUP BY ALL), dirs AS (SELECT base AS a, quote AS b, m.r AS rate, m, false AS inv FROM q1 UNION ALL SELECT quote, base, 1/m.r, m, true FROM q1),
 legs AS (SELECT a, b, arg_min(rate*(20000-m.s)/20000*(10000-m.f)/10000, inv) AS leg, min(inv) AS inv FROM dirs GROUP BY a, b),
 walk AS (SELECT DISTINCT a AS source, a AS target, [a] AS path, 1.0::DOUBLE AS applied, 0 AS back, 0 AS k FROM legs UNION ALL
  SELECT source, b, list_append(path, b), applied*leg, back+inv::INT, k+1 FROM (SELECT w.*, l.b, l.leg, l.inv, row_number() OVER (PARTITION BY w.source, l.b ORDER BY w.path) AS n FROM walk w JOIN legs l ON l.a=w.target WHERE k<6 AND NOT list_contains(w.path, l.b)) WHERE n=1),
 best AS (SELECT source, target, arg_min({{'path': path, 'applied': applied, 'back': back}}, {{'k': k, 'path': path}}) AS p FROM walk GROUP BY ALL)"""

_FACE = """xyz AS (SELECT id, cos(radians(lat))*cos(radians(lon)) AS x, cos(radians(lat))*sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM points),
 ax AS (SELECT *, CASE WHEN abs(x)>abs(y) AND abs(x)>abs(z) THEN 0 WHEN abs(x)<=abs(y) AND abs(y)>abs(z) THEN 1 ELSE 2 END AS a FROM xyz), fc AS (SELECT *, a+CASE WHEN [x,y,z][a+1]<0 THEN 3 ELSE 0 END AS f FROM ax),
 uv AS (SELECT id, f, CASE f WHEN 0 THEN y/x WHEN 1 THEN -x/y WHEN 2 THEN -x/z WHEN 3 THEN z/x WHEN 4 THEN z/y ELSE -y/z END AS u, CASE f WHEN 0 THEN z/x WHEN 1 THEN z/y WHEN 2 THEN -y/z WHEN 3 THEN y/x WHEN 4 THEN -x/y ELSE -x/z END AS v FROM fc),
 st AS (SELECT id, f, CASE WHEN u>=0 THEN 0.5*sqrt(1+3*u) ELSE 1-0.5*sqrt(1-3*u) END AS s, CASE WHEN v>=0 THEN 0.5*sqrt(1+3*v) ELSE 1-0.5*sqrt(1-3*v) END AS t FROM uv),
 ij AS (SELECT id, f, greatest(0,least(1073741823,floor(s*1073741824)))::BIGINT AS i, greatest(0,least(1073741823,floor(t*1073741824)))::BIGINT AS j FROM st),
 hil AS (SELECT id, f, i, j, 29 AS k, f&1 AS o, 0::HUGEINT AS pos FROM ij UNION ALL SELECT id, f, i, j, k-1, xor(o, [1,0,0,3][q+1]), pos*4+q FROM (SELECT *, [0,1,3,2,0,3,1,2,2,3,1,0,2,1,3,0][o*4+((i>>k)&1)*2+((j>>k)&1)+1] AS q FROM hil WHERE k>=0)),
 cell AS (SELECT id, f::HUGEINT*2305843009213693952+pos*2+1 AS c FROM hil WHERE k=-1)"""
_TOKEN = "regexp_replace(printf('%016x', (c//{0}*{0}+{1})::UBIGINT),'0+$','')"


def _token(level: int) -> str:
    low = 1 << (2 * (30 - level))
    return _TOKEN.format(2 * low, low)


QUERIES = {
    "sp19_tokens": (sp19_tokens, v.oracle(f"SELECT id, {_token(4)} AS t4, {_token(12)} AS t12, {_token(30)} AS t30 FROM cell", "points", recursive=_FACE)),
    "sp19_nested": (sp19_nested, v.oracle(f"SELECT {_token(3)} AS token, count(*) AS n, sum(id)::BIGINT AS ids FROM cell GROUP BY 1", "points", recursive=_FACE)),
    "sp16_utm": (sp16_utm, v.oracle(f"SELECT id, {_ZONE} AS zone, true AS own, true AS next FROM points", "points")),
    "sp16_meridian": (sp16_meridian, v.oracle(f"SELECT id, 500000.0::DOUBLE AS x, round(0.9996*{_ARC}+CASE WHEN lat<0 THEN 10000000 ELSE 0 END,2) AS y FROM points", "points")),
    "sp16_mercator_back": (sp16_mercator_back, v.oracle(f"SELECT id, round(degrees(2*atan(exp(lat*100000/{gd.A!r}))-pi()/2),7) AS lat, round(degrees(lon*100000/{gd.A!r}),7) AS lon FROM points", "points")),
    "n03_sobol": (n03_sobol, "SELECT c_custkey, " + ", ".join(map(_xor, range(8))) + " FROM (SELECT c_custkey, xor(c_custkey, c_custkey>>1) AS g FROM customer)"),
    "n03_hypercube": (n03_hypercube, f"SELECT c_custkey, {_CELL.replace('{a}', 'x')}, {_CELL.replace('{a}', 'y')} FROM customer"),
    "z09_props": (z09_props, "SELECT event_id, replace(props,' ','') AS text, sha256(replace(props,' ','')) AS digest FROM events"),
    "x03_nested": (x03_nested, "SELECT p_partkey, CASE WHEN p_partkey%3<2 THEN '{\"a\":null,\"z\":['||p_partkey||',{\"a\":\"'||regexp_replace(p_name,'[\"\\\\]','','g')||'\",\"b\":'||p_partkey||'.5}],\"é\":100}' END AS text FROM part"),
    "x04_identity": (x04_identity, "SELECT n_nationkey, 'nation:'||substr(sha256('{\"kind\":\"nation\",\"parts\":[\"'||n_name||'\",\"'||n_regionkey||'\"]}'),1,24) AS id FROM nation"),
    "m01_fees": (m01_fees, v.oracle(f"SELECT o_orderkey, array_to_string(p.path,'>') AS path, p.applied IS NOT NULL AS converted, round(p.applied,8) AS applied, p.back AS back FROM orders JOIN customer ON o_custkey=c_custkey LEFT JOIN best ON source={CODE.format('c_nationkey')} AND target={CODE.format('o_orderkey%25')}", recursive=RATES)),
}
