"""Domain views over the driver tables.

The same relations are built twice: as DataFrames here, and as common table
expressions of DuckDB in ``ORACLE`` for the queries' SQL twins. Times have no
zone in the files and mean UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.lineage import written

AT = "1998-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """entity_id, entity_type, name of regions, nations, suppliers, parts and customers."""
    parts = [
        ("region", "r_regionkey", "region", "r_name"), ("nation", "n_nationkey", "country", "n_name"), ("supplier", "s_suppkey", "facility", "s_name"),
        ("part", "p_partkey", "other", "p_name"), ("customer", "c_custkey", "company", "c_name"),
    ]
    out = None
    for name, key, kind, label in parts:
        df = table(spark, sf, name).select(F.concat(F.lit(f"{name}:"), F.col(key).cast("string")).alias("entity_id"), F.lit(kind).alias("entity_type"), F.col(label).alias("name"))
        out = df if out is None else out.unionByName(df)
    return out


def _lines_of(lines: DataFrame, key: str, kind: str, of: DataFrame | None) -> DataFrame:
    """Lines whose ``key`` is of an entity among ``of`` (src), which are few and go to the lines; all lines for None."""
    if of is None:
        return lines
    keys = of.where(F.col("src").startswith(f"{kind}:")).select(F.substring_index("src", ":", -1).try_cast("bigint").alias(key))
    return lines.join(F.broadcast(keys), key, "left_semi")


def supplies(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """Supplier to part: open from the first ship date to a day after the last. With ``of`` (src), which are few, what leaves these alone."""
    day = F.expr("interval 1 day")
    return (
        _lines_of(table(spark, sf, "lineitem"), "l_suppkey", "supplier", of).groupBy("l_suppkey", "l_partkey")
        .agg(F.min("l_shipdate").alias("valid_from"), (F.max("l_shipdate") + day).alias("valid_to"), F.round(1 - F.avg("l_discount"), 6).alias("strength"), F.round(F.least(F.lit(1.0), F.sum("l_quantity") / 50), 6).alias("capacity"))
        .select(F.concat(F.lit("s:"), "l_suppkey", F.lit(":"), "l_partkey").alias("relationship_id"), F.concat(F.lit("supplier:"), "l_suppkey").alias("src"), F.concat(F.lit("part:"), "l_partkey").alias("dst"), F.lit("supplies").alias("kind"), "valid_from", "valid_to", "strength", "capacity")
    )


def serves(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """Part to customer, by the same window rule; ``of`` as in ``supplies``."""
    day = F.expr("interval 1 day")
    lines = _lines_of(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_shipdate"), "l_partkey", "part", of)
    if of is not None:
        lines = written(lines, "lines")  # their size is known then, so that few lines go to the orders
    lines = lines.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return (
        lines.groupBy("l_partkey", "o_custkey")
        .agg(F.min("l_shipdate").alias("valid_from"), (F.max("l_shipdate") + day).alias("valid_to"), F.round(1 - F.avg("l_discount"), 6).alias("strength"), F.round(F.least(F.lit(1.0), F.sum("l_quantity") / 50), 6).alias("capacity"))
        .select(F.concat(F.lit("v:"), "l_partkey", F.lit(":"), "o_custkey").alias("relationship_id"), F.concat(F.lit("part:"), "l_partkey").alias("src"), F.concat(F.lit("customer:"), "o_custkey").alias("dst"), F.lit("serves").alias("kind"), "valid_from", "valid_to", "strength", "capacity")
    )


def located(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers in nations, nations in regions; always valid."""
    rows = [("customer", "c_custkey", "c_nationkey", "nation", "located_in"), ("supplier", "s_suppkey", "s_nationkey", "nation", "located_in"), ("nation", "n_nationkey", "n_regionkey", "region", "member_of")]
    out = None
    for name, key, to, kind, label in rows:
        df = table(spark, sf, name).select(
            F.concat(F.lit(f"l:{name}:"), key).alias("relationship_id"), F.concat(F.lit(f"{name}:"), key).alias("src"), F.concat(F.lit(f"{kind}:"), to).alias("dst"), F.lit(label).alias("kind"),
            F.lit(None).cast("timestamp_ntz").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(1.0).alias("strength"), F.lit(1.0).alias("capacity"),
        )
        out = df if out is None else out.unionByName(df)
    return out


def relationships(spark: SparkSession, sf: str) -> DataFrame:
    return supplies(spark, sf).unionByName(serves(spark, sf)).unionByName(located(spark, sf))


def trade(spark: SparkSession, sf: str) -> DataFrame:
    """exporter, importer (nation names), sector (brand), value_usd of every line."""
    nation = table(spark, sf, "nation")
    exporter = nation.select(F.col("n_nationkey").alias("ek"), F.col("n_name").alias("exporter"))
    importer = nation.select(F.col("n_nationkey").alias("ik"), F.col("n_name").alias("importer"))
    return (
        table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(exporter, F.col("s_nationkey") == F.col("ek")).join(importer, F.col("c_nationkey") == F.col("ik"))
        .select("exporter", "importer", F.col("p_brand").alias("sector"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value_usd"))
    )


def trade_edges(spark: SparkSession, sf: str, share: float = 0.05) -> DataFrame:
    """src, dst, weight: importers that take more than ``share`` of an exporter's value."""
    pair = trade(spark, sf).groupBy("exporter", "importer").agg(F.sum("value_usd").alias("v"))
    total = pair.groupBy("exporter").agg(F.sum("v").alias("t"))
    share_of = F.col("v") / F.col("t")
    return pair.join(total, "exporter").where((share_of > share) & (F.col("exporter") != F.col("importer"))).select(F.col("exporter").alias("src"), F.col("importer").alias("dst"), F.round(share_of, 6).alias("weight"))


def shocks(spark: SparkSession, sf: str, n: int = 10, severity: float = 0.6) -> DataFrame:
    """The n suppliers of least balance, shocked at AT."""
    rows = table(spark, sf, "supplier").orderBy("s_acctbal", "s_suppkey").limit(n)
    return rows.select(F.concat(F.lit("shock:"), "s_suppkey").alias("shock_id"), F.concat(F.lit("supplier:"), "s_suppkey").alias("source"), F.lit(severity).alias("severity"), F.lit(AT).cast("timestamp_ntz").alias("starts_at"))


def versions(spark: SparkSession, sf: str) -> DataFrame:
    """Record versions: a customer's orders, each valid until the next, known some days later."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("record_key"), F.col("o_orderkey").alias("version_id"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("valid_from"), F.lead("o_orderdate").over(w).alias("valid_to"),
        (F.col("o_orderdate") + F.make_dt_interval(F.pmod("o_orderkey", F.lit(7)).cast("int"))).alias("known_from"),
    )


def timeline(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("sequence"), "value", "event_type")


def points(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    lat = F.greatest(F.lit(-90.0), F.least(F.lit(90.0), e[0].cast("double") * 180))
    lon = F.greatest(F.lit(-180.0), F.least(F.lit(180.0), e[1].cast("double") * 360))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("label"), lat.alias("lat"), lon.alias("lon"))


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Per order: from the first ship date to a day after the last."""
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("s"), (F.max("l_shipdate") + F.expr("interval 1 day")).alias("e"))
    return rows.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("id"), F.col("o_custkey").alias("owner"), "s", "e")


ORACLE = {
    "entities": """SELECT 'region:'||r_regionkey AS entity_id, 'region' AS entity_type, r_name AS name FROM region
        UNION ALL SELECT 'nation:'||n_nationkey, 'country', n_name FROM nation UNION ALL SELECT 'supplier:'||s_suppkey, 'facility', s_name FROM supplier
        UNION ALL SELECT 'part:'||p_partkey, 'other', p_name FROM part UNION ALL SELECT 'customer:'||c_custkey, 'company', c_name FROM customer""",
    "supplies": """SELECT 's:'||l_suppkey||':'||l_partkey AS relationship_id, 'supplier:'||l_suppkey AS src, 'part:'||l_partkey AS dst, 'supplies' AS kind,
        min(l_shipdate) AS valid_from, max(l_shipdate)+INTERVAL 1 DAY AS valid_to, round(1-avg(l_discount),6) AS strength, round(least(1.0, sum(l_quantity)/50),6) AS capacity
        FROM lineitem GROUP BY l_suppkey, l_partkey""",
    "serves": """SELECT 'v:'||l_partkey||':'||o_custkey AS relationship_id, 'part:'||l_partkey AS src, 'customer:'||o_custkey AS dst, 'serves' AS kind,
        min(l_shipdate) AS valid_from, max(l_shipdate)+INTERVAL 1 DAY AS valid_to, round(1-avg(l_discount),6) AS strength, round(least(1.0, sum(l_quantity)/50),6) AS capacity
        FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY l_partkey, o_custkey""",
    "located": """SELECT 'l:customer:'||c_custkey AS relationship_id, 'customer:'||c_custkey AS src, 'nation:'||c_nationkey AS dst, 'located_in' AS kind, CAST(NULL AS TIMESTAMP) AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to, 1.0::DOUBLE AS strength, 1.0::DOUBLE AS capacity FROM customer
        UNION ALL SELECT 'l:supplier:'||s_suppkey, 'supplier:'||s_suppkey, 'nation:'||s_nationkey, 'located_in', NULL, NULL, 1.0, 1.0 FROM supplier
        UNION ALL SELECT 'l:nation:'||n_nationkey, 'nation:'||n_nationkey, 'region:'||n_regionkey, 'member_of', NULL, NULL, 1.0, 1.0 FROM nation""",
    "rels": "SELECT * FROM supplies UNION ALL SELECT * FROM serves UNION ALL SELECT * FROM located",
    "trade": """SELECT e.n_name AS exporter, i.n_name AS importer, p_brand AS sector, l_extendedprice*(1-l_discount) AS value_usd FROM lineitem JOIN orders ON l_orderkey=o_orderkey
        JOIN customer ON o_custkey=c_custkey JOIN supplier ON l_suppkey=s_suppkey JOIN part ON l_partkey=p_partkey JOIN nation e ON s_nationkey=e.n_nationkey JOIN nation i ON c_nationkey=i.n_nationkey""",
    "pairs": "SELECT exporter, importer, sum(value_usd) AS v FROM trade GROUP BY ALL",
    "tedges": """SELECT exporter AS src, importer AS dst, round(v/t,6) AS weight FROM pairs JOIN (SELECT exporter, sum(v) AS t FROM pairs GROUP BY exporter) USING (exporter) WHERE v/t > 0.05 AND exporter<>importer""",
    "shocks": f"""SELECT 'shock:'||s_suppkey AS shock_id, 'supplier:'||s_suppkey AS source, 0.6::DOUBLE AS severity, TIMESTAMP '{AT}' AS starts_at FROM (SELECT * FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 10)""",
    "versions": """SELECT o_custkey AS record_key, o_orderkey AS version_id, o_totalprice AS value, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to,
        o_orderdate + to_days(CAST(o_orderkey % 7 AS INTEGER)) AS known_from FROM orders""",
    "timeline": "SELECT user_id AS key, ts AS at, event_id AS sequence, value, event_type FROM events",
    "points": """SELECT vec_id AS id, label, greatest(-90.0::DOUBLE, least(90.0::DOUBLE, embedding[1]::DOUBLE*180)) AS lat, greatest(-180.0::DOUBLE, least(180.0::DOUBLE, embedding[2]::DOUBLE*360)) AS lon FROM embeddings""",
    "ivals": """SELECT l_orderkey AS id, o_custkey AS owner, s, e FROM (SELECT l_orderkey, min(l_shipdate) AS s, max(l_shipdate)+INTERVAL 1 DAY AS e FROM lineitem GROUP BY 1) JOIN orders ON l_orderkey=o_orderkey""",
}
NEEDS = {"rels": ("supplies", "serves", "located"), "pairs": ("trade",), "tedges": ("trade", "pairs")}


def oracle(body: str, *views: str, recursive: str = "") -> str:
    """DuckDB SQL of ``body`` over the named views (and what they need); ``recursive`` holds further expressions."""
    names = list(dict.fromkeys(n for v in views for n in (*NEEDS.get(v, ()), v)))
    parts = [f"{n} AS ({ORACLE[n]})" for n in names] + ([recursive] if recursive else [])
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + body if parts else body
