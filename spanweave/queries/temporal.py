"""Queries of filters on validity, bitemporal selection, temporal joins and calendar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import views as v
from ..operators import temporal as t

AT = v.AT
A, B = "1998-01-01 00:00:00", "1998-07-01 00:00:00"
SPAN = "valid_from, valid_to"


def f01_filter_entities(s, d):
    wanted = s.createDataFrame([(i, x) for i, x in enumerate(["nation:3", "nation:1", "nation:3", "part:7", "no:1"])], "pos int, entity_id string").groupBy("entity_id").agg(F.min("pos").alias("pos"))
    return v.entities(s, d).join(F.broadcast(wanted), "entity_id").where(F.col("entity_type").isin("country", "other")).select("entity_id", "entity_type", "name", F.rank().over(Window.orderBy("pos")).cast("long").alias("place"))


def f02_filter_relationships(s, d):
    return v.relationships(s, d).where(F.col("kind").isin("supplies", "member_of") & t.active_at(t.instant(AT))).select("relationship_id", "kind", "valid_from", "valid_to")


def f03_active_at(s, d):
    return v.relationships(s, d).where(t.active_at(t.instant(AT))).groupBy("kind").agg(F.count("*").alias("n"), F.min("valid_from").alias("first"), F.round(F.sum("capacity"), 4).alias("capacity"))


def f05_overlaps(s, d):
    return v.relationships(s, d).where(t.overlaps(t.instant(A), t.instant(B))).groupBy("kind").agg(F.count("*").alias("n"), F.max("valid_to").alias("last"))


def f06_entire_window(s, d):
    return v.relationships(s, d).where(t.whole_window(t.instant(A), t.instant(B))).groupBy("kind").agg(F.count("*").alias("n"), F.min("valid_to").alias("first_end"))


def f07_select_at(s, d):
    return v.versions(s, d).where(t.active_at(t.instant(AT))).select("record_key", "version_id", "valid_from", "valid_to")


def f08_select_overlapping(s, d):
    return v.intervals(s, d).where(t.overlaps(t.instant(A), t.instant(B), "s", "e")).select("id", "s", "e")


def j01_interval_join(s, d):
    rows = v.intervals(s, d)
    return t.interval_join(rows, rows.select("id", "owner", "s", "e"), 128, ["owner"]).where("l_id < r_id").select("owner", "l_id", "r_id", "s", "e")


def j11_allen_join(s, d):
    rows = v.intervals(s, d)
    left, right = rows.select("owner", *[F.col(c).alias(f"l_{c}") for c in ("id", "s", "e")]), rows.select("owner", *[F.col(c).alias(f"r_{c}") for c in ("id", "s", "e")])
    return left.join(right, "owner").where("l_id < r_id").select(t.allen(F.col("l_s"), F.col("l_e"), F.col("r_s"), F.col("r_e")).alias("relation")).groupBy("relation").agg(F.count("*").alias("n"))


def j11_allen_counts(s, d):
    """Ordered pairs of an owner's intervals by relation, without making pairs."""
    return t.allen_counts(v.intervals(s, d), "owner").groupBy("relation").agg(F.sum("n").alias("n"))


def j02_as_of(s, d):
    return t.as_of(v.versions(s, d), t.instant(AT), t.instant("1998-01-05 00:00:00")).select("record_key", "version_id", "value", "known_from")


def j03_latest_known(s, d):
    return t.as_of(v.versions(s, d), None, t.instant(AT)).select("record_key", "version_id", "value")


def t07_bitemporal_contains(s, d):
    inside = t.active_at(t.instant(AT)) & (F.col("known_from") <= t.instant(AT))
    return v.versions(s, d).groupBy(inside.alias("inside")).agg(F.count("*").alias("n"))


def t08_index_overlap(s, d):
    return v.versions(s, d).where(t.overlaps(t.instant(A), t.instant("1998-02-01 00:00:00"))).select("record_key", "version_id", "valid_from")


def _probes(s, d):
    return v.table(s, d, "events").select(F.col("user_id").alias("key"), (F.col("ts") + F.expr("interval 1 hour")).alias("at"), F.col("event_id").alias("probe"))


def j04_at_or_before(s, d):
    return t.nearest_point(_probes(s, d), v.timeline(s, d)).select("probe", "key", "point_at", "sequence", "value")


def j04_at_or_after(s, d):
    return t.nearest_point(_probes(s, d), v.timeline(s, d), before=False).select("probe", "key", "point_at", "sequence", "value")


def t09_between(s, d):
    lo, hi = v.timeline(s, d).agg(F.min("at").alias("lo"), F.max("at").alias("hi")).first()
    third = (hi - lo) / 3
    return v.timeline(s, d).where((F.col("at") >= F.lit(lo + third).cast("timestamp_ntz")) & (F.col("at") < F.lit(lo + 2 * third).cast("timestamp_ntz"))).groupBy("key").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def w11_latest(s, d):
    return v.timeline(s, d).groupBy("key").agg(F.max_by(F.struct("at", "sequence", "value"), F.struct("at", "sequence")).alias("p")).select("key", "p.at", "p.sequence", "p.value")


GRAINS = ["second", "minute", "hour", "day", "week", "month", "quarter", "year"]


def t01_floor(s, d):
    return v.table(s, d, "events").select("event_id", *[t.floor_to(F.col("ts"), g).alias(f"at_{g}") for g in GRAINS])


def t02_add(s, d):
    o = F.col("o_orderdate")
    return v.table(s, d, "orders").select("o_orderkey", t.step(o, "month", 1).alias("month"), t.step(o, "quarter", 1).alias("quarter"), t.step(o, "year", -1).alias("year"), t.step(o, "week", 2).alias("week"), t.step(o, "hour", 5).alias("hour"))


def t03_bucket(s, d):
    start, end = t.bucket(F.col("ts"), "hour")
    return v.table(s, d, "events").groupBy(start.alias("start"), end.alias("end")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def t05_extents(s, d):
    lo, hi = t.instant(A), t.instant(B)
    start, end = F.greatest(F.col("s"), lo), F.least(F.col("e"), hi)
    seconds = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6
    return v.intervals(s, d).where(t.overlaps(lo, hi, "s", "e")).select("id", start.alias("start"), end.alias("end"), F.round(seconds, 3).alias("seconds"), ((F.col("s") >= lo) & (F.col("e") <= hi)).alias("inside"))


def t11_ogc(s, d):
    text = F.concat(F.coalesce(F.date_format("valid_from", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("..")), F.lit("/"), F.coalesce(F.date_format("valid_to", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("..")))
    parsed = F.try_to_timestamp(F.regexp_replace(F.split(F.col("text"), "/")[1], "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")
    return v.versions(s, d).select("version_id", text.alias("text")).select("version_id", "text", parsed.alias("end"))


def t12_rfc3339(s, d):
    return v.table(s, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("text"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))


def t13_windows(s, d):
    seconds = (F.unix_micros(F.col("e").cast("timestamp")) - F.unix_micros(F.col("s").cast("timestamp"))) / 1e6
    return v.intervals(s, d).select("id", F.round(seconds / 3600, 6).alias("hours"), F.round(seconds / 86400, 6).alias("days"), F.to_date("s").alias("day"), (F.col("s") + F.make_dt_interval(secs=(seconds / 2).cast("decimal(18,6)"))).alias("midpoint"))


EXTENT = "(valid_from IS NULL OR valid_from <= TIMESTAMP '{a}') AND (valid_to IS NULL OR TIMESTAMP '{a}' < valid_to)"
ON = EXTENT.format(a=AT)
OVER = f"(valid_to IS NULL OR valid_to > TIMESTAMP '{A}') AND (valid_from IS NULL OR valid_from < TIMESTAMP '{B}')"
ALLEN = """CASE WHEN a.e<b.s THEN 'before' WHEN a.e=b.s THEN 'meets' WHEN b.e<a.s THEN 'after' WHEN b.e=a.s THEN 'met_by' WHEN a.s=b.s AND a.e=b.e THEN 'equals' WHEN a.s=b.s AND a.e<b.e THEN 'starts'
 WHEN a.s=b.s THEN 'started_by' WHEN a.e=b.e AND a.s>b.s THEN 'finishes' WHEN a.e=b.e THEN 'finished_by' WHEN a.s>b.s AND a.e<b.e THEN 'during' WHEN a.s<b.s AND a.e>b.e THEN 'contains' WHEN a.s<b.s THEN 'overlaps' ELSE 'overlapped_by' END"""
PROBES = "probes AS (SELECT user_id AS key, ts + INTERVAL 1 HOUR AS at, event_id AS probe FROM events)"
LAST = "SELECT probe, p.key, q.at AS point_at, q.sequence, q.value FROM probes p LEFT JOIN LATERAL (SELECT * FROM timeline t WHERE t.key=p.key AND t.at {op} p.at ORDER BY t.at {o}, t.sequence {o} LIMIT 1) q ON true"

QUERIES = {
    "f01_filter_entities": (f01_filter_entities, v.oracle("SELECT entity_id, entity_type, name, row_number() OVER (ORDER BY CASE entity_id WHEN 'nation:3' THEN 0 WHEN 'nation:1' THEN 1 ELSE 3 END) AS place FROM entities WHERE entity_id IN ('nation:3','nation:1','part:7','no:1') AND entity_type IN ('country','other')", "entities")),
    "f02_filter_relationships": (f02_filter_relationships, v.oracle(f"SELECT relationship_id, kind, valid_from, valid_to FROM rels WHERE kind IN ('supplies','member_of') AND {ON}", "rels")),
    "f03_active_at": (f03_active_at, v.oracle(f"SELECT kind, count(*) AS n, min(valid_from) AS first, round(sum(capacity),4) AS capacity FROM rels WHERE {ON} GROUP BY kind", "rels")),
    "f05_overlaps": (f05_overlaps, v.oracle(f"SELECT kind, count(*) AS n, max(valid_to) AS last FROM rels WHERE {OVER} GROUP BY kind", "rels")),
    "f06_entire_window": (f06_entire_window, v.oracle(f"SELECT kind, count(*) AS n, min(valid_to) AS first_end FROM rels WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '{A}') AND (valid_to IS NULL OR valid_to >= TIMESTAMP '{B}') GROUP BY kind", "rels")),
    "f07_select_at": (f07_select_at, v.oracle(f"SELECT record_key, version_id, valid_from, valid_to FROM versions WHERE {ON}", "versions")),
    "f08_select_overlapping": (f08_select_overlapping, v.oracle(f"SELECT id, s, e FROM ivals WHERE e > TIMESTAMP '{A}' AND s < TIMESTAMP '{B}'", "ivals")),
    "j01_interval_join": (j01_interval_join, v.oracle("SELECT a.owner, a.id AS l_id, b.id AS r_id, greatest(a.s,b.s) AS s, least(a.e,b.e) AS e FROM ivals a JOIN ivals b ON a.owner=b.owner AND a.id<b.id AND a.s<b.e AND b.s<a.e", "ivals")),
    "j11_allen_counts": (j11_allen_counts, v.oracle(f"SELECT {ALLEN} AS relation, count(*)::BIGINT AS n FROM ivals a JOIN ivals b ON a.owner=b.owner AND a.id<>b.id GROUP BY 1", "ivals")),
    "j11_allen_join": (j11_allen_join, v.oracle(f"SELECT {ALLEN} AS relation, count(*) AS n FROM ivals a JOIN ivals b ON a.owner=b.owner AND a.id<b.id GROUP BY 1", "ivals")),
    "j02_as_of": (j02_as_of, v.oracle(f"SELECT record_key, version_id, value, known_from FROM versions WHERE {ON} AND known_from <= TIMESTAMP '1998-01-05' QUALIFY row_number() OVER (PARTITION BY record_key ORDER BY known_from DESC NULLS LAST, version_id DESC)=1", "versions")),
    "j03_latest_known": (j03_latest_known, v.oracle(f"SELECT record_key, version_id, value FROM versions WHERE known_from <= TIMESTAMP '{AT}' QUALIFY row_number() OVER (PARTITION BY record_key ORDER BY known_from DESC NULLS LAST, version_id DESC)=1", "versions")),
    "t07_bitemporal_contains": (t07_bitemporal_contains, v.oracle(f"SELECT ({ON}) AND known_from <= TIMESTAMP '{AT}' AS inside, count(*) AS n FROM versions GROUP BY 1", "versions")),
    "t08_index_overlap": (t08_index_overlap, v.oracle(f"SELECT record_key, version_id, valid_from FROM versions WHERE (valid_to IS NULL OR valid_to > TIMESTAMP '{A}') AND valid_from < TIMESTAMP '1998-02-01'", "versions")),
    "j04_at_or_before": (j04_at_or_before, v.oracle(LAST.format(op="<=", o="DESC"), "timeline", recursive=PROBES)),
    "j04_at_or_after": (j04_at_or_after, v.oracle(LAST.format(op=">=", o="ASC"), "timeline", recursive=PROBES)),
    "t09_between": (t09_between, v.oracle("SELECT key, count(*) AS n, round(sum(value),4) AS total FROM timeline, (SELECT min(\"at\") AS lo, max(\"at\") AS hi FROM timeline) WHERE \"at\" >= lo + to_microseconds(CAST(round((epoch_us(hi)-epoch_us(lo))/3.0) AS BIGINT)) AND \"at\" < lo + to_microseconds(CAST(round(2*(epoch_us(hi)-epoch_us(lo))/3.0) AS BIGINT)) GROUP BY key", "timeline")),
    "w11_latest": (w11_latest, v.oracle("SELECT key, \"at\", sequence, value FROM timeline QUALIFY row_number() OVER (PARTITION BY key ORDER BY \"at\" DESC, sequence DESC)=1", "timeline")),
    "t01_floor": (t01_floor, "SELECT event_id, " + ", ".join(f"CAST(date_trunc('{g}', ts) AS TIMESTAMP) AS at_{g}" for g in GRAINS) + " FROM events"),
    "t02_add": (t02_add, "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS month, o_orderdate + INTERVAL 3 MONTH AS quarter, o_orderdate - INTERVAL 12 MONTH AS year, o_orderdate + INTERVAL 14 DAY AS week, o_orderdate + INTERVAL 5 HOUR AS hour FROM orders"),
    "t03_bucket": (t03_bucket, "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, CAST(date_trunc('hour', ts) AS TIMESTAMP) + INTERVAL 1 HOUR AS \"end\", count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY 1, 2"),
    "t05_extents": (t05_extents, v.oracle(f"SELECT id, greatest(s, TIMESTAMP '{A}') AS start, least(e, TIMESTAMP '{B}') AS \"end\", round((epoch_us(least(e, TIMESTAMP '{B}'))-epoch_us(greatest(s, TIMESTAMP '{A}')))/1e6,3) AS seconds, s>=TIMESTAMP '{A}' AND e<=TIMESTAMP '{B}' AS inside FROM ivals WHERE e > TIMESTAMP '{A}' AND s < TIMESTAMP '{B}'", "ivals")),
    "t11_ogc": (t11_ogc, v.oracle("SELECT version_id, coalesce(strftime(valid_from,'%Y-%m-%dT%H:%M:%SZ'),'..')||'/'||coalesce(strftime(valid_to,'%Y-%m-%dT%H:%M:%SZ'),'..') AS text, date_trunc('second', valid_to)::TIMESTAMP AS \"end\" FROM versions", "versions")),
    "t12_rfc3339": (t12_rfc3339, "SELECT event_id, strftime(ts,'%Y-%m-%dT%H:%M:%S.%fZ') AS text, epoch_us(ts) AS micros FROM events"),
    "t13_windows": (t13_windows, v.oracle("SELECT id, round((epoch_us(e)-epoch_us(s))/3.6e9,6) AS hours, round((epoch_us(e)-epoch_us(s))/8.64e10,6) AS days, CAST(s AS DATE) AS day, s + to_microseconds(CAST((epoch_us(e)-epoch_us(s))/2 AS BIGINT)) AS midpoint FROM ivals", "ivals")),
}
