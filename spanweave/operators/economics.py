"""Trade aggregates, input-output solutions, money and units, intervention portfolios."""

from __future__ import annotations

import itertools
from decimal import ROUND_HALF_EVEN, Decimal, localcontext

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

PRECISION = 34
EXACT_ITEMS = 28


def bounded(rows: DataFrame, most: int) -> list:
    """All rows on the driver; an error if there are more than ``most``."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"this takes up to {most} rows")
    return found


def neumann(coefficients: DataFrame, demand: DataFrame, terms: int) -> DataFrame:
    """sector, output: demand + A demand + A A demand ..., so many terms; coefficients has i, j, a."""
    coefficients = cut(coefficients)
    term = cut(demand.select(F.col("sector"), F.col("d").alias("x")))
    total = term
    for _ in range(terms):
        term = cut(coefficients.join(term, coefficients.j == term.sector).groupBy(F.col("i").alias("sector")).agg(F.sum(F.col("a") * F.col("x")).alias("x")))
        total = total.unionByName(term)
    return total.groupBy("sector").agg(F.sum("x").alias("output"))


def leontief(models: DataFrame) -> DataFrame:
    """model, sector, output of x = (I - A)^-1 d for each model's rows (model, i, j, a, d_i); an error if A does not converge."""
    kind = models.schema["model"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sectors = sorted(set(pdf["i"]) | set(pdf["j"]))
        at = {x: k for k, x in enumerate(sectors)}
        a, d = np.zeros((len(sectors),) * 2), np.zeros(len(sectors))
        for i, j, x, y in zip(pdf["i"], pdf["j"], pdf["a"], pdf["d"], strict=True):
            a[at[i], at[j]] = x
            d[at[i]] = y
        if np.abs(np.linalg.eigvals(a)).max() >= 1:
            raise ValueError("the spectral radius is 1 or more")
        return pd.DataFrame({"model": pdf["model"].iloc[0], "sector": sectors, "output": np.linalg.solve(np.eye(len(sectors)) - a, d)})

    return models.groupBy("model").applyInPandas(run, f"model {kind}, sector string, output double")


def rate_path(rates: dict[tuple[str, str], Decimal], source: str, target: str) -> list[tuple[str, str]]:
    """Fewest hops through quoted pairs, either way round; the least names win ties. ``rates`` is a small table."""
    near: dict[str, set[str]] = {}
    for a, b in rates:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    level = {source: [source]}
    seen = {source}
    while level and target not in level:
        new: dict[str, list[str]] = {}
        for way in sorted(level.values()):
            for x in sorted(near.get(way[-1], ())):
                if x not in seen and x not in new:
                    new[x] = [*way, x]
        seen |= set(new)
        level = new
    way = level.get(target)
    if way is None:
        raise ValueError(f"no rate from {source} to {target}")
    return list(itertools.pairwise(way))


def convert_money(rates: dict[tuple[str, str], Decimal], source: str, target: str, spread_bps: int = 0, scale: int = 2):
    """A function of amounts: exact decimals of 34 digits along the rate path, spread taken at each leg, half-even at the end."""
    legs = rate_path(rates, source, target) if source != target else []

    @F.pandas_udf("decimal(38,6)")
    def run(amounts: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            with localcontext() as ctx:
                ctx.prec = PRECISION
                value = Decimal(x)
                for a, b in legs:
                    value = value * rates[a, b] if (a, b) in rates else value / rates[b, a]
                    value = value * (Decimal(10_000 - spread_bps) / Decimal(10_000))
                return value.quantize(Decimal(1).scaleb(-scale), ROUND_HALF_EVEN)

        return amounts.map(one)

    return run


def convert_unit(value: Column, scale: Column, offset: Column, scale2: Column, offset2: Column) -> Column:
    """Affine unit conversion through the base unit."""
    return (value * scale + offset - offset2) / scale2


def greedy(items: list[tuple[str, float, float]], budget: float) -> list[str]:
    """Ids in order of value per cost; one that does not fit is passed over and the walk goes on."""
    chosen, left = [], budget
    for name, cost, value in sorted(items, key=lambda x: (-(x[2] / x[1] if x[1] else float("inf")), x[0])):
        if cost <= left + 1e-12 and value > 0:
            chosen.append(name)
            left -= cost
    return sorted(chosen)


def knapsack(items: list[tuple[str, float, float]], budget: float) -> tuple[list[str], str]:
    """Best set within the budget, by branch and bound up to EXACT_ITEMS items, else greedy; the least list of ids wins ties."""
    if len(items) > EXACT_ITEMS:
        return greedy(items, budget), "feasible_not_proven_optimal"
    order = sorted(items, key=lambda x: (-(x[2] / x[1] if x[1] else float("inf")), x[0]))
    best: tuple[float, list[str]] = (0.0, [])

    def bound(k: int, left: float, value: float) -> float:
        for _, cost, gain in order[k:]:
            if cost > left:
                return value + (gain * left / cost if cost else 0)
            left, value = left - cost, value + gain
        return value

    stack = [(0, budget, 0.0, ())]
    while stack:
        k, left, value, taken = stack.pop()
        names = sorted(taken)
        if value > best[0] + 1e-12 or (abs(value - best[0]) <= 1e-12 and names and (not best[1] or names < best[1])):
            best = (value, names)
        if k == len(order) or bound(k, left, value) < best[0] - 1e-12:
            continue
        name, cost, gain = order[k]
        stack.append((k + 1, left, value, taken))
        if cost <= left + 1e-12:
            stack.append((k + 1, left - cost, value + gain, (*taken, name)))
    return best[1], "optimal"


def integer_knapsack(items: list[tuple[str, int, float]], capacity: int) -> tuple[list[str], float]:
    """Exact choice by dynamic programming over whole weights."""
    best = np.zeros(capacity + 1)
    took = np.zeros((len(items), capacity + 1), bool)
    for k, (_, weight, value) in enumerate(items):
        if weight > capacity:
            continue
        new = best.copy()
        new[weight:] = np.maximum(best[weight:], best[: capacity + 1 - weight] + value)
        took[k] = new > best + 1e-12
        best = new
    chosen, left = [], capacity
    for k in range(len(items) - 1, -1, -1):
        if took[k, left]:
            chosen.append(items[k][0])
            left -= items[k][1]
    return sorted(chosen), float(best[capacity])
