"""Queries of statistics, anomaly scores, recurrences, fusion and patterns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import views as v
from ..operators import scans as sc
from ..operators import stats as st


def _tl(s, d):
    return v.timeline(s, d)


def a02_weighted_mean(s, d):
    return v.table(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.sum("l_quantity"), 4).alias("mean"))


def a11_fuse(s, d):
    rows = _tl(s, d)
    first = rows.groupBy(F.col("key").alias("subject"), "event_type").agg(F.min_by("value", "sequence").alias("v"), (F.count_distinct("value") > 1).alias("conflict"))
    return first.groupBy("subject").agg(F.count("*").alias("attributes"), F.round(F.avg(F.col("conflict").cast("int")), 6).alias("conflict_ratio"), F.round(F.sum("v"), 4).alias("total"))


def a12_weighted_numeric(s, d):
    rows = _tl(s, d).select("key", "value", (F.pmod("sequence", F.lit(4)) / 4).alias("w"))
    per = rows.groupBy("key").agg(F.sum("w").alias("sw"), (F.sum(F.col("value") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"), F.avg("value").alias("plain"))
    est = per.select("key", F.when(F.col("sw") > 0, F.col("m")).otherwise(F.col("plain")).alias("estimate"), "sw")
    gap = rows.join(est, "key").groupBy("key").agg(F.first("estimate").alias("estimate"), F.first("sw").alias("sw"), F.avg(F.abs(F.col("value") - F.col("estimate"))).alias("gap"))
    return gap.select("key", F.round("estimate", 5).alias("estimate"), F.round(F.when(F.col("sw") > 0, 1 / (1 + F.col("gap"))).otherwise(0.0), 6).alias("confidence"))


def a13_dependency_profile(s, d):
    """Suppliers of each part and the greatest's share; supplies has one row a supplier and part, and strengths of six digits add up exactly, in any order."""
    n, total = F.count("src"), F.sum(F.col("strength").cast("decimal(18,6)")).cast("double")
    return v.supplies(s, d).groupBy(F.col("dst").alias("entity")).agg(n.alias("upstream"), F.round(F.max("strength") / total, 9).alias("concentration"), (n == 1).alias("single_point"))


def a14_patterns(s, d):
    per = v.trade(s, d).groupBy("importer", "sector", "exporter").agg(F.sum("value_usd").alias("w")).groupBy("importer", "sector").agg(F.count("*").alias("incoming"), F.round(F.max("w") / F.sum("w"), 9).alias("share"))
    kind = F.when(F.col("incoming") == 1, "single_point").when(F.col("share") >= 0.8, "concentration")
    return per.select("importer", "sector", kind.alias("pattern"), "share").where("pattern is not null")


def a15_quality(s, d):
    """A document's latest measurement by dimension, weighted; null where one is missing."""
    lab = v.table(s, d, "labels")
    m = lab.select("doc_id", F.lit("quality").alias("dim"), F.col("quality").cast("double").alias("x"), F.lit(1).alias("at")).unionByName(lab.select("doc_id", F.lit("safety").alias("dim"), (1 - F.col("toxic")).cast("double").alias("x"), F.lit(2).alias("at"))).unionByName(lab.where("doc_id % 3 > 0").select("doc_id", F.lit("quality").alias("dim"), F.lit(0.5).alias("x"), F.lit(3).alias("at")))
    m = m.where("not (dim = 'safety' and doc_id % 7 = 0)")
    last = m.groupBy("doc_id", "dim").agg(F.max_by("x", "at").alias("x"))
    wide = last.groupBy("doc_id").agg(F.max(F.when(F.col("dim") == "quality", F.col("x"))).alias("q"), F.max(F.when(F.col("dim") == "safety", F.col("x"))).alias("t"))
    return wide.select("doc_id", F.round((3 * F.col("q") + 2 * F.col("t")) / 5, 6).alias("score"))


def a16_controls(s, d):
    c = v.table(s, d, "customer").select("c_nationkey", (F.col("c_acctbal") >= 0).alias("ok"), "c_name")
    return c.groupBy("c_nationkey").agg(F.bool_and("ok").alias("passed"), F.sum((~F.col("ok")).cast("int")).alias("failed"), F.coalesce(F.min(F.when(~F.col("ok"), F.col("c_name"))), F.lit("")).alias("first_failed"))


def a17_cvar(s, d):
    out = st.worst_mean(v.table(s, d, "events"), ["event_type"], "value", 0.9)
    return out.select("event_type", F.round("cvar", 6).alias("cvar"), F.round("floor", 6).alias("floor"))


def a18_coverage(s, d):
    e = v.table(s, d, "events").select("event_type", "value").join(v.table(s, d, "events").groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd")), "event_type")
    return e.groupBy("event_type").agg(F.round(F.avg(F.col("value").between(F.col("m") - F.col("sd"), F.col("m") + F.col("sd")).cast("double")), 9).alias("coverage"))


def a19_quantile(s, d):
    return st.rank_value(v.table(s, d, "events"), ["event_type"], "value", st.conformal_rank(0.1), "quantile").select("event_type", F.round("quantile", 6).alias("quantile"))


def a20_conformal(s, d):
    e = v.table(s, d, "events")
    m = e.groupBy("event_type").agg(F.avg("value").alias("m"))
    q = st.rank_value(e.join(m, "event_type").withColumn("r", F.abs(F.col("value") - F.col("m"))), ["event_type"], "r", st.conformal_rank(0.1), "q")
    return m.join(q, "event_type").select("event_type", F.round(F.col("m") - F.col("q"), 6).alias("lower"), F.round(F.col("m") + F.col("q"), 6).alias("upper"))


def a21_spearman(s, d):
    rows = v.table(s, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    ranked = st.average_ranks(st.average_ranks(rows, ["l_returnflag"], "x", "rx"), ["l_returnflag"], "y", "ry")
    return ranked.groupBy("l_returnflag").agg(F.round(st.pearson("x", "y"), 6).alias("pearson"), F.round(st.pearson("rx", "ry"), 6).alias("spearman"))


def a22_sensitivity(s, d):
    n = v.table(s, d, "part").agg(F.avg("p_retailprice").alias("p"), F.avg("p_size").alias("z"))
    change = s.createDataFrame([("price", 1.1, 1.0), ("size", 1.0, 1.1)], "factor string, fp double, fz double")
    return n.crossJoin(change).select("factor", F.round(F.col("p") * F.col("fp") * F.sqrt(F.col("z") * F.col("fz")) - F.col("p") * F.sqrt("z"), 4).alias("delta"))


def a23_monte_carlo(s, d):
    """Mean, spread and rank quantiles of samples; ``lower`` and ``upper`` follow the rank rule of the quantile."""
    e = v.table(s, d, "events").select(F.lit(1).alias("g"), F.sqrt(F.abs("value")).alias("x"))
    m = e.groupBy("g").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("sd"))
    lo, hi = st.rank_value(e, ["g"], "x", st.conformal_rank(0.05), "lower"), st.rank_value(e, ["g"], "x", st.conformal_rank(0.95), "upper")
    return m.join(lo, "g").join(hi, "g").select("mean", "sd", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), F.round("upper", 6).alias("lower_corrected"), F.round("lower", 6).alias("upper_corrected"))


def a24_impact_score(s, d):
    return v.table(s, d, "part").select("p_partkey", F.round(F.sqrt((F.pow(F.col("p_size") / 50, 2) + F.pow(F.col("p_retailprice") / 2000, 2) + F.lit(0.25)) / 3), 9).alias("score"))


def a25_robust_score(s, d):
    e = _tl(s, d)
    m = e.groupBy("key").agg(F.median("value").alias("med"), F.stddev_pop("value").alias("sd"))
    mad = e.join(m, "key").groupBy("key").agg(F.median(F.abs(F.col("value") - F.col("med"))).alias("mad"))
    rows = e.join(m, "key").join(mad, "key")
    return rows.select("sequence", F.round(st.robust_score(F.col("value"), F.col("med"), F.col("mad"), F.col("sd"), 3.0), 5).alias("score"))


def w03_ewma(s, d):
    return sc.ewma(_tl(s, d), 0.3).select("key", F.round("ewma", 6).alias("ewma"))


def w04_cusum(s, d):
    return st.ordered_values(_tl(s, d)).select("key", F.array_join(st.cusum("values", 50.0, 5.0, 60.0).cast("array<string>"), ",").alias("alarms"))


def w05_holt(s, d):
    return st.holt(_tl(s, d).select("key", "at", "sequence", "value"), 3).select("key", F.round("forecast", 6).alias("forecast"), F.round("scale", 6).alias("scale"))


def w05_holt_linear(s, d):
    """Damped trend of each user's values, with the interval of its residuals."""
    found = sc.holt_linear(_tl(s, d), damp=0.95)
    return found.select("key", *[F.round(c, 6).alias(c) for c in ("estimate", "lower", "upper", "scale")])


def w06_persistence(s, d):
    e = _tl(s, d)
    last = e.groupBy("key").agg(F.max_by("value", F.struct("at", "sequence")).alias("value"), F.stddev_pop("value").alias("u"))
    return last.select("key", F.round("value", 6).alias("value"), F.round(F.greatest(F.lit(0.0), F.col("value") - F.col("u")), 6).alias("lower"), F.round(F.col("value") + F.col("u"), 6).alias("upper"))


def w07_zscore(s, d):
    w = Window.partitionBy("key")
    z = (F.col("value") - F.avg("value").over(w)) / F.nullif(F.stddev_pop("value").over(w), F.lit(0.0))
    return _tl(s, d).select("sequence", F.round(z, 6).alias("z"), (F.abs(z) >= 2.5).alias("anomaly"))


def n01_distributions(s, d):
    from pyspark.sql.functions import pandas_udf

    cdf = pandas_udf(st.normal_cdf, "double")
    x = (F.col("p_size") - 25) / 10
    return v.table(s, d, "part").select("p_partkey", F.round(F.exp(-x * x / 2) / F.sqrt(F.lit(2) * F.pi()), 9).alias("pdf"), F.round(cdf(x), 9).alias("cdf"))


def n02_intervals(s, d):
    p = v.table(s, d, "part").select("p_partkey", (F.col("p_size") - 1).cast("double").alias("a0"), (F.col("p_size") + 2).cast("double").alias("a1"), F.pmod("p_partkey", F.lit(9)).cast("double").alias("b0"), (F.pmod("p_partkey", F.lit(9)) + 30).cast("double").alias("b1"))
    lo, hi = F.greatest("a0", "b0"), F.least("a1", "b1")
    return p.select("p_partkey", (F.col("a0") + F.col("b0")).alias("sum_lower"), (F.col("a1") + F.col("b1")).alias("sum_upper"), (F.col("a0") * F.col("b0")).alias("product_lower"), (F.col("a1") * F.col("b1")).alias("product_upper"), F.when(lo <= hi, lo).alias("lower"), F.when(lo <= hi, hi).alias("upper"))


def k08_explain(s, d):
    m = v.table(s, d, "lineitem").groupBy("l_returnflag").agg(F.avg(F.col("l_quantity") - 25).alias("quantity"), F.avg(F.col("l_discount") * 100 - 5).alias("discount"), F.avg(F.col("l_tax") * 100 - 4).alias("tax"))
    long = m.unpivot("l_returnflag", ["quantity", "discount", "tax"], "feature", "contribution").withColumn("contribution", F.round("contribution", 6))
    return long.select("l_returnflag", "feature", "contribution", F.row_number().over(Window.partitionBy("l_returnflag").orderBy(F.desc(F.abs("contribution")), "feature")).cast("long").alias("place"))


def z06_upstreams(s, d):
    return v.supplies(s, d).groupBy("dst").agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("upstreams"))


TL = "timeline"
RANKED = "e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS n, count(*) OVER (PARTITION BY event_type) AS c FROM events)"
SEQ = "q AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY \"at\", sequence) AS k FROM timeline)"
QUERIES = {
    "a02_weighted_mean": (a02_weighted_mean, "SELECT l_returnflag, round(sum(l_extendedprice*l_quantity)/sum(l_quantity),4) AS mean FROM lineitem GROUP BY 1"),
    "a11_fuse": (a11_fuse, v.oracle("SELECT subject, count(*) AS attributes, round(avg(CASE WHEN c>1 THEN 1 ELSE 0 END),6) AS conflict_ratio, round(sum(x),4) AS total FROM (SELECT key AS subject, event_type, arg_min(value, sequence) AS x, count(DISTINCT value) AS c FROM timeline GROUP BY ALL) GROUP BY subject", TL)),
    "a12_weighted_numeric": (a12_weighted_numeric, v.oracle("SELECT key, round(any_value(estimate),5) AS estimate, round(CASE WHEN any_value(sw)>0 THEN 1/(1+avg(abs(value-estimate))) ELSE 0 END,6) AS confidence FROM timeline JOIN (SELECT key, sum(sequence%4/4) AS sw, CASE WHEN sum(sequence%4/4)>0 THEN sum(value*(sequence%4/4))/sum(sequence%4/4) ELSE avg(value) END AS estimate FROM timeline GROUP BY key) USING (key) GROUP BY key", TL)),
    "a13_dependency_profile": (a13_dependency_profile, v.oracle("SELECT dst AS entity, count(DISTINCT src) AS upstream, round(max(strength)/sum(strength),9) AS concentration, count(DISTINCT src)=1 AS single_point FROM supplies GROUP BY dst", "supplies")),
    "a14_patterns": (a14_patterns, v.oracle("SELECT importer, sector, CASE WHEN c=1 THEN 'single_point' ELSE 'concentration' END AS pattern, share FROM (SELECT importer, sector, count(*) AS c, round(max(w)/sum(w),9) AS share FROM (SELECT importer, sector, exporter, sum(value_usd) AS w FROM trade GROUP BY ALL) GROUP BY ALL) WHERE c=1 OR share>=0.8", "trade")),
    "a15_quality": (a15_quality, "SELECT doc_id, round((3*q+2*t)/5,6) AS score FROM (SELECT doc_id, CASE WHEN doc_id%3>0 THEN 0.5 ELSE quality END::DOUBLE AS q, CASE WHEN doc_id%7=0 THEN NULL ELSE 1-toxic END::DOUBLE AS t FROM labels)"),
    "a16_controls": (a16_controls, "SELECT c_nationkey, bool_and(c_acctbal>=0) AS passed, sum(CASE WHEN c_acctbal<0 THEN 1 ELSE 0 END)::BIGINT AS failed, coalesce(min(CASE WHEN c_acctbal<0 THEN c_name END),'') AS first_failed FROM customer GROUP BY 1"),
    "a17_cvar": (a17_cvar, "WITH " + RANKED + " SELECT event_type, round(avg(value),6) AS cvar, round(min(value),6) AS floor FROM e WHERE n <= greatest(1, floor(c*(1-0.9::DOUBLE)+0.999999)) GROUP BY 1"),
    "a18_coverage": (a18_coverage, "SELECT event_type, round(avg(CASE WHEN value BETWEEN m-sd AND m+sd THEN 1.0 ELSE 0.0 END),9)::DOUBLE AS coverage FROM events JOIN (SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd FROM events GROUP BY 1) USING (event_type) GROUP BY 1"),
    "a19_quantile": (a19_quantile, "WITH " + RANKED + " SELECT event_type, round(value,6) AS quantile FROM e WHERE n = greatest(1, least(c, ceil((c+1)*(1-0.1::DOUBLE))))"),
    "a20_conformal": (a20_conformal, "WITH m AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1), r AS (SELECT event_type, m, abs(value-m) AS r, row_number() OVER (PARTITION BY event_type ORDER BY abs(value-m)) AS n, count(*) OVER (PARTITION BY event_type) AS c FROM events JOIN m USING (event_type)) SELECT event_type, round(m-r,6) AS lower, round(m+r,6) AS upper FROM r WHERE n = greatest(1, least(c, ceil((c+1)*(1-0.1::DOUBLE))))"),
    "a21_spearman": (a21_spearman, "WITH r AS (SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity)+(count(*) OVER (PARTITION BY l_returnflag, l_quantity)-1)/2 AS rx, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice)+(count(*) OVER (PARTITION BY l_returnflag, l_extendedprice)-1)/2 AS ry FROM lineitem) SELECT l_returnflag, round(corr(x,y),6) AS pearson, round(corr(rx,ry),6) AS spearman FROM r GROUP BY 1"),
    "a22_sensitivity": (a22_sensitivity, "SELECT factor, round(p*fp*sqrt(z*fz)-p*sqrt(z),4) AS delta FROM (SELECT avg(p_retailprice) AS p, avg(p_size) AS z FROM part), (VALUES ('price',1.1::DOUBLE,1.0::DOUBLE),('size',1.0,1.1)) t(factor,fp,fz)"),
    "a23_monte_carlo": (a23_monte_carlo, "WITH e AS (SELECT sqrt(abs(value)) AS x, row_number() OVER (ORDER BY sqrt(abs(value))) AS n, count(*) OVER () AS c FROM events), b AS (SELECT max(CASE WHEN n=greatest(1,least(c,ceil((c+1)*(1-0.05::DOUBLE)))) THEN round(x,6) END) AS lo, max(CASE WHEN n=greatest(1,least(c,ceil((c+1)*(1-0.95::DOUBLE)))) THEN round(x,6) END) AS hi, round(avg(x),6) AS mean, round(stddev_pop(x),6) AS sd FROM e) SELECT mean, sd, lo AS lower, hi AS upper, hi AS lower_corrected, lo AS upper_corrected FROM b"),
    "a24_impact_score": (a24_impact_score, "SELECT p_partkey, round(sqrt((pow(p_size/50,2)+pow(p_retailprice/2000,2)+0.25)/3),9) AS score FROM part"),
    "a25_robust_score": (a25_robust_score, v.oracle("SELECT sequence, round(CASE WHEN mad>0 THEN abs(value-med)/(1.4826*mad) WHEN sd>0 THEN abs(value-med)/sd WHEN value=med THEN 0 ELSE 3 END,5)::DOUBLE AS score FROM timeline JOIN (SELECT key, median(value) AS med, stddev_pop(value) AS sd FROM timeline GROUP BY key) USING (key) JOIN (SELECT key, median(abs(value-med)) AS mad FROM timeline JOIN (SELECT key, median(value) AS med FROM timeline GROUP BY key) USING (key) GROUP BY key) USING (key)", TL)),
    "w03_ewma": (w03_ewma, v.oracle("SELECT key, round(arg_max(y,k),6) AS ewma FROM r GROUP BY key", TL, recursive=SEQ + ", r AS (SELECT key, k, value AS y FROM q WHERE k=1 UNION ALL SELECT q.key, q.k, 0.3*q.value+(1-0.3)*r.y FROM r JOIN q ON q.key=r.key AND q.k=r.k+1)")),
    "w04_cusum": (w04_cusum, v.oracle("SELECT key, coalesce(string_agg(CASE WHEN hit THEN (k-1)::VARCHAR END, ',' ORDER BY k),'') AS alarms FROM r WHERE k>0 GROUP BY key", TL, recursive=SEQ + ", r AS (SELECT DISTINCT key, 0::BIGINT AS k, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, false AS hit FROM q UNION ALL SELECT key, k, CASE WHEN u>60 OR w>60 THEN 0 ELSE u END, CASE WHEN u>60 OR w>60 THEN 0 ELSE w END, u>60 OR w>60 FROM (SELECT q.key, q.k, greatest(0.0, r.up+q.value-50-5) AS u, greatest(0.0, r.dn+50-q.value-5) AS w FROM r JOIN q ON q.key=r.key AND q.k=r.k+1))")),
    "w05_holt": (w05_holt, None),
    "w05_holt_linear": (w05_holt_linear, v.oracle("SELECT key, round(estimate,6) AS estimate, round(estimate-1.2815515655446004*scale,6) AS lower, round(estimate+1.2815515655446004*scale,6) AS upper, round(scale,6) AS scale FROM (SELECT key, arg_max(l+0.95*b, k) AS estimate, greatest(1e-12, 1.4826*(list_sort(list(abs(off-centre)) FILTER (k>1)))[(count(*)-1)//2+1]) AS scale FROM (SELECT *, avg(off) OVER (PARTITION BY key) AS centre FROM r) GROUP BY key HAVING max(k)>1)", TL, recursive=SEQ + ", s0 AS (SELECT a.key, 1::BIGINT AS k, a.value AS l, b.value-a.value AS b, NULL::DOUBLE AS off FROM q a JOIN q b ON a.key=b.key AND a.k=1 AND b.k=2), r AS (SELECT * FROM s0 UNION ALL SELECT key, k, n, t, v-l-0.95*t FROM (SELECT *, 0.2*(n-l)+0.8*b AS t FROM (SELECT q.key, q.k, q.value AS v, r.l, r.b, 0.35*q.value+0.65*(r.l+0.95*r.b) AS n FROM r JOIN q ON q.key=r.key AND q.k=r.k+1)))")),
    "w06_persistence": (w06_persistence, v.oracle("SELECT key, round(x,6) AS value, round(greatest(0.0,x-u),6) AS lower, round(x+u,6) AS upper FROM (SELECT key, arg_max(value, (\"at\", sequence)) AS x, stddev_pop(value) AS u FROM timeline GROUP BY key)", TL)),
    "w07_zscore": (w07_zscore, v.oracle("SELECT sequence, round(z,6) AS z, abs(z)>=2.5 AS anomaly FROM (SELECT sequence, (value-avg(value) OVER (PARTITION BY key))/nullif(stddev_pop(value) OVER (PARTITION BY key),0) AS z FROM timeline)", TL)),
    "n01_distributions": (n01_distributions, None),
    "n02_intervals": (n02_intervals, "SELECT p_partkey, a0+b0 AS sum_lower, a1+b1 AS sum_upper, a0*b0 AS product_lower, a1*b1 AS product_upper, CASE WHEN greatest(a0,b0)<=least(a1,b1) THEN greatest(a0,b0) END AS lower, CASE WHEN greatest(a0,b0)<=least(a1,b1) THEN least(a1,b1) END AS upper FROM (SELECT p_partkey, (p_size-1)::DOUBLE AS a0, (p_size+2)::DOUBLE AS a1, (p_partkey%9)::DOUBLE AS b0, (p_partkey%9+30)::DOUBLE AS b1 FROM part)"),
    "k08_explain": (k08_explain, "WITH m AS (SELECT l_returnflag, unnest(['quantity','discount','tax']) AS feature, unnest([round(avg(l_quantity-25),6), round(avg(l_discount*100-5),6), round(avg(l_tax*100-4),6)]) AS contribution FROM lineitem GROUP BY l_returnflag) SELECT l_returnflag, feature, contribution, row_number() OVER (PARTITION BY l_returnflag ORDER BY abs(contribution) DESC, feature) AS place FROM m"),
    "z06_upstreams": (z06_upstreams, v.oracle("SELECT dst, string_agg(DISTINCT src, ',' ORDER BY src) AS upstreams FROM supplies GROUP BY dst", "supplies")),
}
