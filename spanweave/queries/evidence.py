"""Queries of evidence stores, integrity, policy, provenance, text and sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import views as v
from ..operators import evidence as ev
from ..sources import formats


def _docs(s, d):
    return v.table(s, d, "documents")


def io02_sql(s, d):
    return formats.sql_over(s, f"{d}/lineitem.parquet", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM source WHERE l_shipdate < :until GROUP BY ALL", until="1998-01-01")


def io03_integrity(s, d):
    """Idempotent put: an id may come twice only with one content."""
    rows = _docs(s, d).select("doc_id", F.sha2("text", 256).alias("h"))
    twice = rows.unionByName(rows.where("doc_id % 10 = 0")).unionByName(rows.where("doc_id % 25 = 0").withColumn("h", F.lit("other")))
    per = twice.groupBy("doc_id").agg(F.count_distinct("h").alias("k"), F.count("*").alias("c"))
    return per.agg(F.count("*").alias("ids"), F.sum((F.col("k") > 1).cast("int")).alias("collisions"), F.sum("c").alias("puts"))


def io06_dedup_content(s, d):
    return ev.once_each(_docs(s, d).select("doc_id", ev.content_address().alias("digest")), "doc_id", "digest")


def io07_verify(s, d):
    rows = _docs(s, d).select("doc_id", ev.content_address().alias("digest"), F.octet_length("text").alias("size"), F.substring(ev.content_address(), 1, 2).alias("shard"))
    return rows.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("bytes"), F.min("digest").alias("first"))


def io08_chain(s, d):
    c = v.table(s, d, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("digest"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    stated = c.withColumn("previous", F.when(F.col("turn") % 5 == 4, F.lit("broken")).otherwise(F.lag("digest").over(w)))
    return ev.chain_breaks(stated, "conv_id", "turn", "digest", "previous").select("conv_id", "turn")


def io14_json_rows(s, d):
    n = v.table(s, d, "nation")
    return n.select(F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey")).alias("row"))


def io16_registry(s, d):
    """Hosts of pages, looked up by alias."""
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    alias = F.regexp_replace(host, r"^(www|m|blog)\.", "")
    return v.table(s, d, "pages").groupBy(alias.alias("source")).agg(F.count("*").alias("n"), F.count_distinct(host).alias("aliases"))


def io17_ccsds(s, d):
    """Orbit records, one a supplier, read from their text; those without an epoch give none."""
    line = lambda k, x: F.concat(F.lit(f"{k} = "), x)
    epoch = F.when(F.col("s_suppkey") % 5 == 0, F.lit("COMMENT none")).otherwise(F.lit("EPOCH = 2026-01-01T00:00:00"))
    text = F.concat_ws("\n", line("OBJECT_NAME", F.col("s_name")), line("OBJECT_ID", F.col("s_suppkey").cast("string")), epoch, line("MEAN_MOTION", (F.col("s_nationkey") + 0.5).cast("string")), F.lit("ECCENTRICITY = 0.0006"))
    return formats.key_values(v.table(s, d, "supplier").select(text.alias("text")), ["OBJECT_NAME", "OBJECT_ID", "EPOCH", "MEAN_MOTION", "ECCENTRICITY"])


def io18_rinex(s, d):
    """Headers with versions and systems by part, read by their columns."""
    p = v.table(s, d, "part")
    version = F.lpad(F.format_string("%.2f", F.lit(3.0) + F.col("p_size") / 100), 9, " ")
    system = F.when(F.col("p_partkey") % 2 == 0, "M: MIXED").otherwise("G: GPS")
    head = F.concat(F.rpad(version, 20, " "), F.rpad(F.lit("OBSERVATION DATA"), 20, " "), F.rpad(system, 20, " "), F.lit("RINEX VERSION / TYPE"))
    return formats.rinex_header(p.select(head.alias("text"))).groupBy("version", "kind", "system").agg(F.count("*").alias("n"))


def io21_normalise(s, d):
    p = v.table(s, d, "part")
    return p.select("p_partkey", F.upper(F.trim("p_brand")).alias("code"), F.upper(F.regexp_replace("p_type", r"\s+", "_")).alias("measure"))


def io22_assets(s, d):
    c = v.table(s, d, "supplier")
    bad = F.array_compact(F.array(F.when(F.col("s_acctbal") < 0, F.lit("negative_balance")), F.when(~F.col("s_nationkey").between(0, 24), F.lit("unknown_nation")), F.when(F.length(F.trim("s_name")) == 0, F.lit("blank_name"))))
    return c.select("s_suppkey", F.array_join(bad, ",").alias("violations"))


def io23_secret_scan(s, d):
    return ev.secret_lines(_docs(s, d)).groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


def io24_csv(s, d):
    r = v.table(s, d, "region")
    return r.select(F.to_csv(F.struct("r_regionkey", "r_name")).alias("line"), F.concat(F.lit("| "), "r_regionkey", F.lit(" | "), "r_name", F.lit(" |")).alias("markdown"))


def f13_by_source(s, d):
    return _docs(s, d).groupBy("source").agg(F.count("*").alias("n"), F.min(F.sha2("text", 256)).alias("first"))


def f14_relationships_for(s, d):
    return v.relationships(s, d).where((F.col("src") == "nation:3") | (F.col("dst") == "nation:3")).select("relationship_id", "kind")


def f15_external_id(s, d):
    """An accepted resolution goes before the direct id."""
    c = v.table(s, d, "customer").select("c_custkey", "c_name")
    res = c.where("c_custkey % 4 = 0").select("c_name", (F.col("c_custkey") - 1).alias("target"), F.when(F.col("c_custkey") % 8 == 0, "accepted").otherwise("rejected").alias("decision"))
    ok = res.where("decision = 'accepted'").select("c_name", "target")
    return c.join(ok, "c_name", "left").select("c_name", F.coalesce("target", "c_custkey").alias("entity"))


def f16_violations(s, d):
    r = v.relationships(s, d)
    rules = F.array_compact(F.array(F.when(~F.col("strength").between(0, 1), F.lit("strength")), F.when(F.col("capacity") < 0.5, F.lit("low_capacity")), F.when(F.col("valid_to") <= F.col("valid_from"), F.lit("window")), F.when(F.col("src") == F.col("dst"), F.lit("loop"))))
    return r.select("kind", F.explode(rules).alias("rule")).groupBy("kind", "rule").agg(F.count("*").alias("n"))


def f17_policy(s, d):
    lab = v.table(s, d, "labels")
    out = ev.policy(F.when(F.col("quality") == 1, 0.9).otherwise(0.3), F.col("toxic") == 0)
    return lab.groupBy(out.alias("decision")).agg(F.count("*").alias("n"))


def f18_claims(s, d):
    lab = v.table(s, d, "labels").withColumn("status", F.when(F.col("doc_id") % 3 == 0, "observed").when(F.col("doc_id") % 3 == 1, "modeled").otherwise("asserted"))
    ok = F.when(F.col("status") == "observed", F.col("quality") == 1).when(F.col("status") == "modeled", F.col("toxic") == 0).otherwise(True)
    return lab.groupBy("status").agg(F.count("*").alias("n"), F.sum(ok.cast("int")).alias("valid"))


def j05_integrity(s, d):
    ids = v.entities(s, d).where("entity_id not rlike '^part:.*9$'").select("entity_id")
    ends = v.relationships(s, d).select("kind", F.explode(F.array("src", "dst")).alias("entity_id"))
    return ends.join(ids, "entity_id", "left_anti").groupBy("kind").agg(F.count("*").alias("missing"), F.count_distinct("entity_id").alias("ids"))


def v01_ancestors(s, d):
    c = v.table(s, d, "conversations")
    node = F.concat("conv_id", F.lit(":"), "turn")
    parents = c.select(node.alias("node"), F.when(F.col("turn") > 0, F.concat("conv_id", F.lit(":"), F.col("turn") - 1)).alias("parent"))
    return ev.ancestors(parents).groupBy("node").agg(F.count("*").alias("n"))


def v03_receipts(s, d):
    size = F.octet_length("text")
    return _docs(s, d).select("doc_id", F.concat(F.lit("evidence:"), F.substring(F.sha2(F.concat(F.col("source"), F.lit("|"), ev.content_address()), 256), 1, 32)).alias("receipt"), size.cast("long").alias("content_length"))


def v04_unknown_license(s, d):
    known = F.col("text").rlike("(?i)licensed under|released under")
    return _docs(s, d).groupBy("source").agg(F.sum((~known).cast("int")).alias("unknown"), F.count("*").alias("n"))


def w12_hash_chain(s, d):
    c = v.table(s, d, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("h"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.select("conv_id", "turn", F.sha2(F.concat(F.coalesce(F.lag("h").over(w), F.lit("")), "h"), 256).alias("link"))


def x01_normalize(s, d):
    return v.table(s, d, "part").select("p_partkey", ev.collapse(F.concat(F.lit("  "), "p_name", F.lit(" \t\n "), "p_type", F.lit(" "))).alias("text"), F.lower("p_brand").alias("folded"))


def x01_nfkc(s, d):
    n = ev.nfkc()
    return _docs(s, d).select("doc_id", F.sha2(n(F.col("text")), 256).alias("digest"))


def x02_iri(s, d):
    ok = F.col("url").rlike(r"^[a-z][a-z0-9+.-]*://[^\s<>\"]+$")
    return v.table(s, d, "pages").groupBy(ok.alias("valid"), F.regexp_extract("url", r"^([a-z]+)://", 1).alias("scheme")).agg(F.count("*").alias("n"))


def x04_ids(s, d):
    return v.table(s, d, "nation").select("n_name", ev.flat_id("identity", F.col("n_name"), F.col("n_nationkey").cast("string")).alias("id"))


def x06_selectors(s, d):
    t = F.col("text")
    return _docs(s, d).select("doc_id", F.substring(t, 5, 20).alias("position"), F.element_at(F.split(t, "\n"), 1).alias("line"), F.instr(t, "the").cast("long").alias("quote_at"))


def z16_host_allow(s, d):
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    return v.table(s, d, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("n")).withColumn("permitted", F.col("host").endswith(".example.com") | (F.col("host") == "example.com"))


def z14_envelope(s, d):
    lab = v.table(s, d, "labels").select("doc_id", F.array(F.concat(F.lit("e"), "doc_id")).alias("a"), F.when(F.col("toxic") == 1, F.array(F.lit("t"), F.lit("e0"))).otherwise(F.array(F.lit("e0"))).alias("b"))
    return lab.select("doc_id", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("evidence"))


HOST = r"regexp_extract(url,'://([^/?#]*)',1)"
RULE = "CASE " + " ".join(f"WHEN regexp_matches(line, '{shape.replace(chr(39), chr(39) * 2)}') THEN '{name}'" for name, shape in ev.SECRETS) + " END"
CH = "c AS (SELECT conv_id, turn, sha256(text) AS h, lag(sha256(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)"
QUERIES = {
    "io02_sql": (io02_sql, "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity),2) AS quantity FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY ALL"),
    "io03_integrity": (io03_integrity, "SELECT count(*) AS ids, sum(CASE WHEN doc_id%25=0 THEN 1 ELSE 0 END)::BIGINT AS collisions, sum(1+CASE WHEN doc_id%10=0 THEN 1 ELSE 0 END+CASE WHEN doc_id%25=0 THEN 1 ELSE 0 END)::BIGINT AS puts FROM documents"),
    "io06_dedup_content": (io06_dedup_content, "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1"),
    "io07_verify": (io07_verify, "SELECT substr(sha256(text),1,2) AS shard, count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS bytes, min(sha256(text)) AS first FROM documents GROUP BY 1"),
    "io08_chain": (io08_chain, "WITH " + CH + " SELECT conv_id, turn FROM c WHERE turn%5=4"),
    "io14_json_rows": (io14_json_rows, """SELECT '{"n_nationkey":'||n_nationkey||',"n_name":"'||n_name||'","n_regionkey":'||n_regionkey||'}' AS row FROM nation"""),
    "io16_registry": (io16_registry, f"SELECT regexp_replace({HOST}, '^(www|m|blog)\\.', '') AS source, count(*) AS n, count(DISTINCT {HOST}) AS aliases FROM pages GROUP BY 1"),
    "io17_ccsds": (io17_ccsds, "SELECT s_name AS object_name, s_suppkey::VARCHAR AS object_id, '2026-01-01T00:00:00' AS epoch, s_nationkey||'.5' AS mean_motion, '0.0006' AS eccentricity FROM supplier WHERE s_suppkey%5<>0"),
    "io18_rinex": (io18_rinex, "SELECT round(3+p_size/100,2)::DOUBLE AS version, 'O' AS kind, CASE WHEN p_partkey%2=0 THEN 'M' ELSE 'G' END AS system, count(*) AS n FROM part GROUP BY ALL"),
    "io21_normalise": (io21_normalise, "SELECT p_partkey, upper(trim(p_brand)) AS code, upper(regexp_replace(p_type,'\\s+','_','g')) AS measure FROM part"),
    "io22_assets": (io22_assets, "SELECT s_suppkey, CASE WHEN s_acctbal<0 THEN 'negative_balance' ELSE '' END AS violations FROM supplier"),
    "io23_secret_scan": (io23_secret_scan, f"SELECT rule, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, {RULE} AS rule FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE rule IS NOT NULL GROUP BY rule"),
    "io24_csv": (io24_csv, "SELECT r_regionkey||','||r_name AS line, '| '||r_regionkey||' | '||r_name||' |' AS markdown FROM region"),
    "f13_by_source": (f13_by_source, "SELECT source, count(*) AS n, min(sha256(text)) AS first FROM documents GROUP BY 1"),
    "f14_relationships_for": (f14_relationships_for, v.oracle("SELECT relationship_id, kind FROM rels WHERE src='nation:3' OR dst='nation:3'", "rels")),
    "f15_external_id": (f15_external_id, "SELECT c_name, CASE WHEN c_custkey%8=0 THEN c_custkey-1 ELSE c_custkey END AS entity FROM customer"),
    "f16_violations": (f16_violations, v.oracle("SELECT kind, rule, count(*) AS n FROM (SELECT kind, unnest([CASE WHEN NOT strength BETWEEN 0 AND 1 THEN 'strength' END, CASE WHEN capacity<0.5 THEN 'low_capacity' END, CASE WHEN valid_to<=valid_from THEN 'window' END, CASE WHEN src=dst THEN 'loop' END]) AS rule FROM rels) WHERE rule IS NOT NULL GROUP BY ALL", "rels")),
    "f17_policy": (f17_policy, "SELECT CASE WHEN toxic<>0 THEN 'deny' WHEN quality<>1 THEN 'review' ELSE 'allow' END AS decision, count(*) AS n FROM labels GROUP BY 1"),
    "f18_claims": (f18_claims, "SELECT CASE doc_id%3 WHEN 0 THEN 'observed' WHEN 1 THEN 'modeled' ELSE 'asserted' END AS status, count(*) AS n, sum(CASE WHEN doc_id%3=0 THEN quality WHEN doc_id%3=1 THEN 1-toxic ELSE 1 END)::BIGINT AS valid FROM labels GROUP BY 1"),
    "j05_integrity": (j05_integrity, v.oracle("SELECT kind, count(*) AS missing, count(DISTINCT x) AS ids FROM (SELECT kind, src AS x FROM rels UNION ALL SELECT kind, dst FROM rels) WHERE x NOT IN (SELECT entity_id FROM entities WHERE NOT regexp_matches(entity_id,'^part:.*9$')) GROUP BY kind", "entities", "rels")),
    "v01_ancestors": (v01_ancestors, "SELECT conv_id||':'||turn AS node, turn AS n FROM conversations WHERE turn>0"),
    "v03_receipts": (v03_receipts, "SELECT doc_id, 'evidence:'||substr(sha256(source||'|'||sha256(text)),1,32) AS receipt, octet_length(encode(text))::BIGINT AS content_length FROM documents"),
    "v04_unknown_license": (v04_unknown_license, "SELECT source, sum(CASE WHEN regexp_matches(text,'(?i)licensed under|released under') THEN 0 ELSE 1 END)::BIGINT AS unknown, count(*) AS n FROM documents GROUP BY 1"),
    "w12_hash_chain": (w12_hash_chain, "WITH " + CH + " SELECT conv_id, turn, sha256(coalesce(p,'')||h) AS link FROM c"),
    "x01_normalize": (x01_normalize, "SELECT p_partkey, trim(regexp_replace(p_name||' '||p_type,'\\s+',' ','g')) AS text, lower(p_brand) AS folded FROM part"),
    "x01_nfkc": (x01_nfkc, None),
    "x02_iri": (x02_iri, r"""SELECT regexp_matches(url,'^[a-z][a-z0-9+.-]*://[^\s<>"]+$') AS valid, regexp_extract(url,'^([a-z]+)://',1) AS scheme, count(*) AS n FROM pages GROUP BY ALL"""),
    "x04_ids": (x04_ids, """SELECT n_name, 'identity:'||substr(sha256('{"kind":"identity","parts":["'||n_name||'","'||n_nationkey||'"]}'),1,32) AS id FROM nation"""),
    "x06_selectors": (x06_selectors, "SELECT doc_id, substr(text,5,20) AS position, string_split(text,chr(10))[1] AS line, instr(text,'the')::BIGINT AS quote_at FROM documents"),
    "z14_envelope": (z14_envelope, "SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(['e'||doc_id], CASE WHEN toxic=1 THEN ['t','e0'] ELSE ['e0'] END))),',') AS evidence FROM labels"),
    "z16_host_allow": (z16_host_allow, f"SELECT host, n, host LIKE '%.example.com' OR host='example.com' AS permitted FROM (SELECT {HOST} AS host, count(*) AS n FROM pages GROUP BY 1)"),
}
