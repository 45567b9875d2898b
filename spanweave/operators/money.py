"""Money in columns: paths of exchange rates with spread and fee on each leg, and conversions with the path they took.

Rates are rows (base, quote, rate, spread_bps, fee_bps). A leg goes along a
quote, or back along the opposite one by its reciprocal where there is no
direct quote; it keeps (20000 - spread) / 20000 of the amount, half of the
spread being each side's, and (10000 - fee) / 10000 of that. Of all paths the
one of fewest legs counts, and of these the first by names. Rates of a path
have 14 digits after the point, amounts are multiplied once and rounded half
to even.

A rate that is null or not above 0, or of a currency to itself, is no quote; of several quotes of one pair
the least counts. An amount without a path, or null, is converted to null;
one in its own currency is only rounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

RATE, LEG = "decimal(20,14)", "decimal(18,12)"


def directed(rates: DataFrame) -> DataFrame:
    """start, end, leg (what one unit becomes), rate, inverted: each pair of currencies once a direction."""
    good = rates.where("rate > 0 AND base <> quote").groupBy("base", "quote").agg(F.min(F.struct(F.col("rate").cast("decimal(18,10)").alias("rate"), "spread_bps", "fee_bps")).alias("q"))
    there = good.select(F.col("base").alias("start"), F.col("quote").alias("end"), "q", F.lit(False).alias("inverted"))
    back = good.select(F.col("quote").alias("start"), F.col("base").alias("end"), "q", F.lit(True).alias("inverted"))
    best = there.unionByName(back).groupBy("start", "end").agg(F.min(F.struct("inverted", "q")).alias("b"))
    rate = F.when(F.col("b.inverted"), F.lit(1).cast("decimal(1,0)") / F.col("b.q.rate")).otherwise(F.col("b.q.rate")).cast(LEG)
    keeps = (F.lit(20_000) - F.coalesce("b.q.spread_bps", F.lit(0))).cast("decimal(5,0)") / 20_000 * ((F.lit(10_000) - F.coalesce("b.q.fee_bps", F.lit(0))).cast("decimal(5,0)") / 10_000)
    return best.select("start", "end", (rate * keeps.cast("decimal(12,10)")).cast(LEG).alias("leg"), rate.alias("rate"), F.col("b.inverted").alias("inverted"))


def rate_paths(rates: DataFrame) -> DataFrame:
    """source, target, path, applied, legs (start, end, rate, inverted) of every pair of currencies that quotes connect.

    The frontier of all sources moves by a join until nothing is new: as many
    rounds as legs. The result has the square of the number of currencies.
    """
    steps = cut(directed(rates))
    one = F.struct("start", "end", "rate", "inverted")
    seen = cut(steps.select(F.col("start").alias("source")).distinct().select("source", F.col("source").alias("target"), F.array("source").alias("path"), F.lit(1).cast(RATE).alias("applied"), F.array().cast("array<struct<start:string,end:string,rate:decimal(18,12),inverted:boolean>>").alias("legs")))
    frontier, found = seen, None
    while True:
        grown = frontier.join(steps, F.col("target") == F.col("start")).select("source", F.col("end").alias("target"), F.concat("path", F.array("end")).alias("path"), (F.col("applied") * F.col("leg")).cast(RATE).alias("applied"), F.concat("legs", F.array(one)).alias("legs"))
        new = grown.join(seen.select("source", "target"), ["source", "target"], "left_anti").groupBy("source", "target").agg(F.min(F.struct("path", "applied", "legs")).alias("p"))
        frontier = cut(new.select("source", "target", "p.path", "p.applied", "p.legs"))
        if frontier.isEmpty():
            return seen.where("source <> target") if found is None else found
        found = frontier if found is None else found.unionByName(frontier)
        seen = seen.unionByName(frontier)


def convert(amounts: DataFrame, rates: DataFrame, scale: int = 2) -> DataFrame:
    """``amounts`` (source, target, amount, ...) with converted (so many digits), applied, path and legs."""
    paths = rate_paths(rates).withColumnsRenamed({"source": "_source", "target": "_target"})
    held = amounts.join(paths, (F.col("source") == F.col("_source")) & (F.col("target") == F.col("_target")), "left").drop("_source", "_target")
    same = F.col("source") == F.col("target")
    applied = F.when(same, F.lit(1).cast(RATE)).otherwise(F.col("applied"))
    value = F.bround(F.col("amount").cast("decimal(17,4)") * applied, scale).cast(f"decimal(28,{scale})")
    return held.withColumns({"converted": value, "applied": applied, "path": F.when(same, F.array("source")).otherwise(F.col("path"))})
