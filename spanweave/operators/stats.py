"""Weighted, robust and conformal statistics, recurrences over ordered values, fusion of records."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


def ordered_values(points: DataFrame, key: str = "key") -> DataFrame:
    """key, values: each key's values in order of time and sequence."""
    return points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "sequence", "value"))).alias("p")).select(key, F.col("p.value").alias("values"))


def ewma(values: str | Column, alpha: float) -> Column:
    """Last value of y0 = x0, y = alpha x + (1 - alpha) y."""
    x = F.col(values) if isinstance(values, str) else values
    return F.aggregate(F.slice(x, 2, F.greatest(F.lit(1), F.size(x))), F.element_at(x, 1), lambda y, v: alpha * v + (1 - alpha) * y)


def cusum(values: str | Column, target: float, drift: float, threshold: float) -> Column:
    """Places (from 0) where either one-sided sum passes the threshold; both start anew there."""
    x = F.col(values) if isinstance(values, str) else values
    start = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("alarms"))

    def step(a: Column, v: Column) -> Column:
        up, down = F.greatest(F.lit(0.0), a.up + v - target - drift), F.greatest(F.lit(0.0), a.down + target - v - drift)
        hit = (up > threshold) | (down > threshold)
        return F.struct(F.when(hit, 0.0).otherwise(up).alias("up"), F.when(hit, 0.0).otherwise(down).alias("down"), (a.i + 1).alias("i"), F.when(hit, F.concat(a.alarms, F.array(a.i))).otherwise(a.alarms).alias("alarms"))

    return F.aggregate(x, start, step, lambda a: a.alarms)


def holt(points: DataFrame, steps: int = 1, alpha: float = 0.35, beta: float = 0.20, damping: float = 0.9) -> DataFrame:
    """key, forecast, scale: damped linear smoothing, one group at a time; scale is 1.4826 times the median absolute error."""
    kind = points.schema["key"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(["at", "sequence"])["value"].to_numpy(float)
        level, trend, errors = x[0], (x[1] - x[0] if len(x) > 1 else 0.0), []
        for v in x[1:]:
            told = level + damping * trend
            errors.append(v - told)
            new = alpha * v + (1 - alpha) * told
            trend = beta * (new - level) + (1 - beta) * damping * trend
            level = new
        ahead = level + trend * sum(damping**k for k in range(1, steps + 1))
        e = np.array(errors) if errors else np.zeros(1)
        scale = 1.4826 * float(np.median(np.abs(e - np.median(e))))
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "forecast": [ahead], "scale": [scale]})

    return points.groupBy("key").applyInPandas(run, f"key {kind}, forecast double, scale double")


def counted(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, _n rows of this value, _before rows of lesser values and _all rows of the group.

    Distinct values are dealt by range; running sums are taken within a range
    and moved by the sums of the ranges before, so no task holds a group.
    """
    ranged = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")).repartitionByRange(*by, value)
    ranged = cut(ranged.withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "_range").agg(F.sum("_n").alias("_of"))
    w = Window.partitionBy(*by)
    ahead = F.coalesce(F.sum("_of").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.struct(*by, "_range").alias("_key"), ahead.alias("_ahead"), F.sum("_of").over(w).alias("_all"))
    inside = F.sum("_n").over(Window.partitionBy(*by, "_range").orderBy(value)) - F.col("_n")
    rows = ranged.withColumn("_inside", inside).withColumn("_mine", F.struct(*by, "_range"))
    both = rows.join(sums, F.col("_mine").eqNullSafe(F.col("_key")))
    return both.select(*by, value, "_n", (F.col("_inside") + F.col("_ahead")).alias("_before"), "_all")


def running(df: DataFrame, by: list[str], order: str, sums: list[str], descending: bool = False) -> DataFrame:
    """``df``, one row a (by, order), with before_<c> for each of ``sums``: its sum over the rows of the group that come before.

    Rows are dealt by range, as in ``counted``; ``by`` and ``order`` may not be null.
    """
    along = F.col(order).desc() if descending else F.col(order).asc()
    ranged = cut(df.repartitionByRange(*by, along).withColumn("_range", F.spark_partition_id()))
    of = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_of_{c}") for c in sums])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = of.select(*by, "_range", *[F.coalesce(F.sum(f"_of_{c}").over(earlier), F.lit(0)).alias(f"_ahead_{c}") for c in sums])
    inside = Window.partitionBy(*by, "_range").orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{c}") for c in sums]).join(ahead, [*by, "_range"])
    return rows.select(*df.columns, *[(F.col(f"_in_{c}") + F.col(f"_ahead_{c}")).alias(f"before_{c}") for c in sums])


def rank_value(df: DataFrame, by: list[str], value: str, rank: Column, name: str) -> DataFrame:
    """The value at a 1-based rank within each group (no interpolation)."""
    rows = counted(df, by, value).withColumn("_rank", F.greatest(F.lit(1), F.least(F.col("_all"), rank)))
    return rows.where("_before < _rank and _rank <= _before + _n").select(*by, F.col(value).alias(name))


def conformal_rank(alpha: float) -> Column:
    return F.ceil((F.col("_all") + 1) * (1 - F.lit(alpha)))


def worst_mean(df: DataFrame, by: list[str], value: str, alpha: float) -> DataFrame:
    """Mean of the worst ceil((1 - alpha) n) values."""
    worst = F.greatest(F.lit(1), F.floor(F.col("_all") * (1 - alpha) + 0.999999))
    rows = counted(df, by, value).withColumn("_n", F.least(F.col("_n"), worst - F.col("_before"))).where("_n > 0")
    return rows.groupBy(*by).agg((F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias("cvar"), F.min(value).alias("floor"))


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the average rank of each value in its group."""
    ranks = counted(df, by, value).select(F.struct(*by, value).alias("_key"), (F.col("_before") + 1 + (F.col("_n") - 1) / 2).alias(name))
    return df.withColumn("_mine", F.struct(*by, value)).join(ranks, F.col("_mine").eqNullSafe(F.col("_key"))).drop("_mine", "_key")


def pearson(x: str, y: str) -> Column:
    """Correlation, 0 where either side does not vary."""
    both = F.covar_pop(x, y)
    spread = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
    return F.when(spread > 1e-12, F.try_divide(both, spread)).otherwise(0.0)


def robust_score(value: Column, median: Column, mad: Column, deviation: Column, threshold: float) -> Column:
    """Distance from the median in robust units; by the standard deviation where the median deviation is 0, else the threshold if different."""
    return F.when(mad > 0, F.abs(value - median) / (1.4826 * mad)).when(deviation > 0, F.abs(value - median) / deviation).when(value == median, 0.0).otherwise(threshold)


def normal_cdf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: 0.5 * (1 + math.erf(v / math.sqrt(2))))


def fuse(records: DataFrame, subject: str, order: str | None = None) -> DataFrame:
    """subject, attributes, conflict, confidence, evidence of records (subject, attribute, value, seq, confidence, evidence_id).

    ``conflict`` is the share of attributes with more than one value;
    ``confidence`` is the mean of the records, less half of it times the
    conflict; ``evidence`` counts distinct ids. With ``order`` (a column without
    ties in a subject) confidences are added one after the other in that order,
    so that the last digits of the sum do not depend on how rows are dealt; a
    subject's rows are then sorted by one task, which may spill.
    """
    per = records.groupBy(subject, "attribute").agg((F.max("value") > F.min("value")).alias("differ"))
    shares = per.groupBy(subject).agg(F.count("attribute").alias("attributes"), F.avg(F.coalesce("differ", F.lit(False)).cast("int")).alias("conflict"))
    mean = F.avg("confidence")
    if order is not None:
        so_far = Window.partitionBy(subject).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        records = records.withColumn("_mean", F.sum("confidence").over(so_far) / F.nullif(F.count("confidence").over(so_far), F.lit(0)))
        mean = F.max_by("_mean", F.struct(order))
    means = records.groupBy(subject).agg(mean.alias("_mean"), F.count_distinct("evidence_id").alias("evidence"))
    return shares.join(means, subject).withColumn("confidence", F.col("_mean") * (1 - 0.5 * F.col("conflict"))).drop("_mean")


def dominance(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, dominance: least value over the mean; 1 where the mean is 0."""
    m = F.avg(value)
    return rows.groupBy(*by).agg(F.when(m == 0, 1.0).otherwise(F.min(value) / m).alias("dominance"))
