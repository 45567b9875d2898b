"""Queries of trade, input-output, money, units and portfolios."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from .. import views as v
from ..operators import economics as ec
from ..operators import money as mo
from . import columns as co


def a04_trade_totals(s, d):
    return v.trade(s, d).groupBy("sector").agg(F.round(F.sum("value_usd"), 4).alias("total"))


def a05_trade_matrix(s, d):
    names = ec.bounded(v.table(s, d, "nation").select("n_name").orderBy("n_name"), 1000)
    names = [r.n_name for r in names]
    wide = v.trade(s, d).groupBy("exporter").pivot("importer", names).agg(F.sum("value_usd")).fillna(0.0)
    return wide.unpivot("exporter", names, "importer", "total").select("exporter", "importer", F.round("total", 4).alias("total"))


def a06_cube(s, d):
    return v.trade(s, d).cube("exporter", "importer").agg(F.round(F.sum("value_usd"), 4).alias("total")).select(F.coalesce("exporter", F.lit("*")).alias("exporter"), F.coalesce("importer", F.lit("*")).alias("importer"), "total")


def a07_hhi(s, d):
    per = v.trade(s, d).groupBy("importer", "exporter").agg(F.sum("value_usd").alias("x"))
    total = per.groupBy("importer").agg(F.sum("x").alias("t"))
    return per.join(total, "importer").groupBy("importer").agg(F.round(F.sum(F.pow(F.col("x") / F.col("t"), 2)), 9).alias("hhi"))


def e01_impact(s, d):
    per = v.trade(s, d).groupBy("exporter").agg(F.sum("value_usd").alias("exposed"))
    return per.select("exporter", F.round(F.col("exposed") * 0.2, 5).alias("direct"), F.round(F.col("exposed") * 0.2 * 0.5, 5).alias("indirect"), F.round(F.col("exposed") * 0.2 * 0.45, 6).alias("value_added"))


def _region_matrix(s, d):
    """Coefficients between regions: shares of each importer's purchases, halved, so that columns sum to one half."""
    n = v.table(s, d, "nation").join(v.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    t = v.trade(s, d).join(n.withColumnsRenamed({"n_name": "exporter", "r_name": "i"}), "exporter").join(n.withColumnsRenamed({"n_name": "importer", "r_name": "j"}), "importer")
    pair = t.groupBy("i", "j").agg(F.sum("value_usd").alias("x"))
    col = pair.groupBy("j").agg(F.sum("x").alias("t"))
    return pair.join(col, "j").select("i", "j", F.round(0.5 * F.col("x") / F.col("t"), 9).alias("a"))


def _demand(s, d):
    return v.table(s, d, "region").select(F.col("r_name").alias("sector"), (F.col("r_regionkey") * 10 + 10).cast("double").alias("d"))


def e02_leontief(s, d):
    rows = _region_matrix(s, d).join(_demand(s, d).withColumnRenamed("sector", "i"), "i").withColumn("model", F.lit("regions"))
    return ec.leontief(rows).select("sector", F.round("output", 4).alias("output"))


def e02_neumann(s, d):
    return ec.neumann(_region_matrix(s, d), _demand(s, d), 12).select("sector", F.round("output", 4).alias("output"))


def e03_indirect(s, d):
    out = ec.neumann(_region_matrix(s, d), _demand(s, d), 12)
    return out.join(_demand(s, d), "sector").select("sector", F.round(F.col("output") - F.col("d"), 4).alias("indirect"))


RATES = {("USD", "EUR"): Decimal("0.92"), ("EUR", "CHF"): Decimal("0.96"), ("GBP", "USD"): Decimal("1.27")}


def m01_convert(s, d):
    chf = ec.convert_money(RATES, "USD", "CHF", spread_bps=10)
    gbp = ec.convert_money(RATES, "USD", "GBP")
    amount = F.round("o_totalprice", 2).cast("decimal(18,2)")
    return v.table(s, d, "orders").select("o_orderkey", chf(amount).cast("decimal(18,2)").cast("double").alias("chf"), gbp(amount).cast("decimal(18,2)").cast("double").alias("gbp"))


def m02_rate_path(s, d):
    """Path of rates between any two nations' currencies."""
    return mo.rate_paths(co.rates(s, d)).select("source", "target", F.array_join("path", ">").alias("path"))


def j10_fx_lookup(s, d):
    """Direct quote, or the reciprocal of the opposite one, between each customer's currency and another."""
    asked = v.table(s, d, "customer").select("c_custkey", co.code(F.col("c_nationkey")).alias("start"), co.code(F.col("c_custkey") % 25).alias("end"))
    return asked.join(mo.directed(co.rates(s, d)), ["start", "end"], "left").select("c_custkey", F.round(F.col("rate").cast("double"), 9).alias("rate"))


def u02_units(s, d):
    p = v.table(s, d, "part")
    one = F.lit(1.0)
    f = ec.convert_unit(F.col("p_size").cast("double"), one, F.lit(273.15), F.lit(5.0) / 9, F.lit(459.67) * 5 / 9)
    return p.select("p_partkey", F.round(ec.convert_unit(F.col("p_size").cast("double"), F.lit(1000.0), F.lit(0.0), F.lit(0.3048), F.lit(0.0)), 6).alias("feet"), F.round(f, 6).alias("fahrenheit"))


def _items(s, d):
    c = v.table(s, d, "customer").groupBy("c_nationkey").agg(F.round(F.sum(F.abs("c_acctbal")) / 1000, 2).alias("cost"), F.count("*").alias("value")).join(v.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return [(r.n_name, float(r.cost), float(r.value)) for r in ec.bounded(c.select("n_name", "cost", "value").orderBy("n_name"), 4096)]


def o02_greedy(s, d):
    return s.createDataFrame([(x,) for x in ec.greedy(_items(s, d), 1500.0)], "intervention string")


def o03_knapsack(s, d):
    names, status = ec.knapsack(_items(s, d), 1500.0)
    return s.createDataFrame([(x, status) for x in names], "intervention string, status string")


def o04_integer_knapsack(s, d):
    names, value = ec.integer_knapsack([(a, int(b), c) for a, b, c in _items(s, d)], 1500)
    return s.createDataFrame([(x, value) for x in names], "intervention string, total double")


def o05_portfolio(s, d):
    """The knapsack under each of two objectives: gain, and gain less risk."""
    items = _items(s, d)
    rows = []
    for objective, weight in (("gain", 0.0), ("risk_adjusted", 0.3)):
        names, status = ec.knapsack([(a, b, c - weight * b / 10) for a, b, c in items], 1500.0)
        rows += [(objective, status, x) for x in names]
    return s.createDataFrame(rows, "objective string, status string, intervention string")


def o06_efficiency(s, d):
    c = v.table(s, d, "customer").groupBy("c_nationkey").agg(F.sum(F.abs("c_acctbal")).alias("cost"), F.count("*").alias("gain"))
    return c.select("c_nationkey", F.round(F.when(F.col("cost") > 0, F.col("gain") / F.col("cost")).otherwise(0.0), 9).alias("efficiency"), F.round(0.7 * F.col("gain") - 0.3 * F.col("cost") / 10000, 6).alias("score"))


def f21_budget(s, d):
    c = v.table(s, d, "customer").groupBy("c_nationkey").agg(F.sum(F.abs("c_acctbal")).alias("cost"))
    return c.groupBy((F.col("cost") <= 250000).alias("permitted")).agg(F.count("*").alias("n"))


REG = "rm AS MATERIALIZED (SELECT i, j, round(0.5*x/sum(x) OVER (PARTITION BY j),9) AS a FROM (SELECT re.r_name AS i, ri.r_name AS j, sum(value_usd) AS x FROM trade JOIN nation ne ON ne.n_name=exporter JOIN region re ON re.r_regionkey=ne.n_regionkey JOIN nation ni ON ni.n_name=importer JOIN region ri ON ri.r_regionkey=ni.n_regionkey GROUP BY ALL)), t0 AS MATERIALIZED (SELECT r_name AS sector, (r_regionkey*10+10)::DOUBLE AS x FROM region)"


def _terms(n: int) -> str:
    return REG + "".join(f", t{k} AS MATERIALIZED (SELECT i AS sector, sum(a*x) AS x FROM rm JOIN t{k-1} ON j=sector GROUP BY i)" for k in range(1, n + 1)) + ", o AS (SELECT sector, sum(x) AS output FROM (" + " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(n + 1)) + ") GROUP BY sector)"


QUERIES = {
    "a04_trade_totals": (a04_trade_totals, v.oracle("SELECT sector, round(sum(value_usd),4) AS total FROM trade GROUP BY sector", "trade")),
    "a05_trade_matrix": (a05_trade_matrix, v.oracle("SELECT a.n_name AS exporter, b.n_name AS importer, round(coalesce(v,0),4) AS total FROM (SELECT DISTINCT exporter AS n_name FROM trade) a CROSS JOIN nation b LEFT JOIN pairs ON exporter=a.n_name AND importer=b.n_name", "pairs")),
    "a06_cube": (a06_cube, v.oracle("SELECT coalesce(exporter,'*') AS exporter, coalesce(importer,'*') AS importer, round(sum(value_usd),4) AS total FROM trade GROUP BY CUBE (exporter, importer)", "trade")),
    "a07_hhi": (a07_hhi, v.oracle("SELECT importer, round(sum(pow(v/t,2)),9) AS hhi FROM pairs JOIN (SELECT importer, sum(v) AS t FROM pairs GROUP BY 1) USING (importer) GROUP BY importer", "pairs")),
    "e01_impact": (e01_impact, v.oracle("SELECT exporter, round(x*0.2,5) AS direct, round(x*0.2*0.5,5) AS indirect, round(x*0.2*0.45,6) AS value_added FROM (SELECT exporter, sum(v) AS x FROM pairs GROUP BY 1)", "pairs")),
    "e02_leontief": (e02_leontief, v.oracle("SELECT sector, round(output,4) AS output FROM o", "trade", recursive=_terms(60))),
    "e02_neumann": (e02_neumann, v.oracle("SELECT sector, round(output,4) AS output FROM o", "trade", recursive=_terms(12))),
    "e03_indirect": (e03_indirect, v.oracle("SELECT o.sector, round(output-x,4) AS indirect FROM o JOIN t0 ON o.sector=t0.sector", "trade", recursive=_terms(12))),
    "m01_convert": (m01_convert, None),
    "m02_rate_path": (m02_rate_path, v.oracle("SELECT source, target, array_to_string(p.path,'>') AS path FROM best WHERE source<>target", recursive=co.RATES)),
    "j10_fx_lookup": (j10_fx_lookup, v.oracle(f"SELECT c_custkey, round(x,9) AS rate FROM customer LEFT JOIN (SELECT a, b, arg_min(rate, inv) AS x FROM dirs GROUP BY a, b) ON a={co.CODE.format('c_nationkey')} AND b={co.CODE.format('c_custkey%25')}", recursive=co.RATES)),
    "u02_units": (u02_units, "SELECT p_partkey, round(p_size*1000/0.3048::DOUBLE,6) AS feet, round((p_size+273.15::DOUBLE-459.67::DOUBLE*5/9)/(5.0::DOUBLE/9),6) AS fahrenheit FROM part"),
    "o02_greedy": (o02_greedy, None),
    "o03_knapsack": (o03_knapsack, None),
    "o04_integer_knapsack": (o04_integer_knapsack, None),
    "o05_portfolio": (o05_portfolio, None),
    "o06_efficiency": (o06_efficiency, "SELECT c_nationkey, round(CASE WHEN cost>0 THEN gain/cost ELSE 0 END,9)::DOUBLE AS efficiency, round(0.7*gain-0.3*cost/10000,6)::DOUBLE AS score FROM (SELECT c_nationkey, sum(abs(c_acctbal)) AS cost, count(*) AS gain FROM customer GROUP BY 1)"),
    "f21_budget": (f21_budget, "SELECT cost<=250000 AS permitted, count(*) AS n FROM (SELECT c_nationkey, sum(abs(c_acctbal)) AS cost FROM customer GROUP BY 1) GROUP BY 1"),
}
