"""Linear recurrences over ordered series, as scans of affine maps.

A step takes a state s to M s + w x, so a run of steps is one affine map
again. Rows are dealt by ranges of key and order; each task composes its first
and its last run, the only ones that may go on in a neighbour, and two rows a
task come to the driver, which hands every task the states its runs begin
with. So a key with any share of the rows runs over as many tasks as it fills.
Within a task states come from doublings in numpy, not from a loop of rows.

Rows of equal key and order are in no defined order: make the order unique.
Null and NaN values are left out; a key without others has no states. Null keys are a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import stats


@dataclass(frozen=True)
class Step:
    """State s becomes matrix s + weight x. Before a key's first value its state is first x0 + second x1; of a lone value x1 is x0."""

    matrix: tuple[tuple[float, ...], ...]
    weight: tuple[float, ...]
    first: tuple[float, ...]
    second: tuple[float, ...]

    def powers(self, n: int) -> np.ndarray:
        """matrix**0 to matrix**n."""
        m = np.array(self.matrix)
        out = np.eye(len(m))[None]
        while len(out) <= n:
            out = np.concatenate([out, out @ (out[-1] @ m)])
        return out[: n + 1]

    def begin(self, x0: float, x1: float) -> np.ndarray:
        return np.array(self.first) * x0 + np.array(self.second) * x1

    def run(self, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        """States after each value."""
        out = x[:, None] * np.array(self.weight)
        power, reach = np.array(self.matrix), 1
        while reach < len(x):
            out[reach:] += out[:-reach] @ power.T
            power, reach = power @ power, 2 * reach
        return out + self.powers(len(x))[1:] @ state


def ewma_step(alpha: float) -> Step:
    return Step(((1 - alpha,),), (alpha,), (1.0,), (0.0,))


def holt_step(alpha: float = 0.35, beta: float = 0.20, damp: float = 1.0) -> Step:
    """Level and trend: l' = alpha x + (1 - alpha)(l + damp b), b' = beta (l' - l) + (1 - beta) b, from (x0, x1 - x0) after the first value."""
    m = ((1 - alpha, (1 - alpha) * damp), (-alpha * beta, beta * (1 - alpha) * damp + 1 - beta))
    # The state before the first value that leads to (x0, x1 - x0): with level + damp * trend = x0.
    share = 1 / (1 - beta + beta * damp)
    return Step(m, (alpha, alpha * beta), (1 + damp * share, -share), (-damp * share, share))


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, object, bool, pd.DataFrame]]:
    """Pieces of a task's rows with one key: range, key, whether it begins a run here, rows."""
    last: object = object()
    for frame in frames:
        keys = frame["key"]
        same = (keys == keys.shift()) | (keys.isna() & keys.shift().isna())
        for _, part in frame.groupby((~same).cumsum().to_numpy(), sort=False):
            key = part["key"].iloc[0]
            key = None if pd.isna(key) else key
            yield int(part["_range"].iloc[0]), key, key != last, part
            last = key


def _summary(step: Step):
    """First and last run of a task: range, place (0, 1), key, n, its first two values, and its map (n powers of the matrix, and what it adds)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[dict] = []
        for at, key, new, part in _runs(frames):
            x = part["value"].to_numpy(float)
            if new:
                found = found[:1] + [{"range": at, "place": min(1, len(found)), "key": key, "n": 0, "x0": x[0], "x1": None, "adds": np.zeros(len(step.weight))}]
            mine = found[-1]
            if mine["x1"] is None and mine["n"] + len(x) > 1:
                mine["x1"] = x[1 - mine["n"]]
            mine["adds"] = step.run(x, mine["adds"])[-1]
            mine["n"] += len(x)
        yield pd.DataFrame([f | {"adds": f["adds"].tolist()} for f in found], columns=["range", "place", "key", "n", "x0", "x1", "adds"])

    return run


def _starts(step: Step, rows: list) -> dict[tuple[int, int], list[float]]:
    """The state that the first and the last run of each range begin with."""
    rows = sorted(rows, key=lambda r: (r["range"], r["place"]))
    out: dict[tuple[int, int], list[float]] = {}
    state, before = None, None
    for k, r in enumerate(rows):
        goes_on = before is not None and before["key"] == r["key"] and before["range"] != r["range"]
        if not goes_on:
            after = rows[k + 1] if k + 1 < len(rows) and rows[k + 1]["key"] == r["key"] and rows[k + 1]["range"] != r["range"] else None
            x1 = r["x1"] if r["x1"] is not None else after["x0"] if after is not None else r["x0"]
            state = step.begin(r["x0"], x1)
        out[r["range"], r["place"]] = state.tolist()
        state = np.linalg.matrix_power(np.array(step.matrix), r["n"]) @ state + np.array(r["adds"])
        before = r
    return out


def scan(points: DataFrame, step: Step, order: tuple[str, ...] = ("at", "sequence")) -> DataFrame:
    """Rows (key, order, value) with ``before`` and ``state``, arrays of the state before and after each value."""
    rows = points.select("key", *order, F.col("value").cast("double").alias("value")).where("value IS NOT NULL AND NOT isnan(value)")
    ranged = cut(rows.repartitionByRange("key", *order).withColumn("_range", F.spark_partition_id()))
    ranged = ranged.sortWithinPartitions("key", *order)
    kind = points.schema["key"].dataType.simpleString()
    told = ranged.select("key", "value", "_range").mapInPandas(_summary(step), f"range int, place int, `key` {kind}, n long, x0 double, x1 double, adds array<double>").collect()
    starts = _starts(step, told)
    ends = {r["range"]: r["key"] for r in sorted(told, key=lambda r: (r["range"], r["place"]))}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, count, ahead = None, 0, None
        for at, key, new, part in _runs(_joined(frames)):
            x = part["value"].to_numpy(float)
            if new:
                known = starts.get((at, 0)) if count == 0 else starts.get((at, 1)) if key == ends[at] else None
                state, count = np.array(known) if known is not None else step.begin(x[0], x[1] if len(x) > 1 else x[0]), count + 1
            states = step.run(x, state)
            before = np.concatenate([state[None], states[:-1]])
            state = states[-1]
            yield part.drop(columns="_range").assign(before=list(before), state=list(states))

    def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Frames that part no run's first row from its second: the last row is held back, and with it the one before if a run begins there."""
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            keys = frame["key"].iloc[-3:-1]
            goes_on = len(keys) == 2 and (keys.iloc[0] == keys.iloc[1] or keys.isna().all())
            rest = max(0, len(frame) - (1 if goes_on else 2))
            held = frame.iloc[rest:]
            if rest:
                yield frame.iloc[:rest]
        if held is not None:
            yield held

    fields = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in ("key", *order))
    return ranged.mapInPandas(run, f"{fields}, value double, before array<double>, state array<double>")


def ewma(points: DataFrame, alpha: float) -> DataFrame:
    """key, ewma: last value of y0 = x0, y = alpha x + (1 - alpha) y."""
    return scan(points, ewma_step(alpha)).groupBy("key").agg(F.max_by(F.col("state")[0], F.struct("at", "sequence")).alias("ewma"))


def holt_linear(points: DataFrame, damp: float = 1.0, z: float = 1.2815515655446004) -> DataFrame:
    """key, estimate, lower, upper, scale of keys with two values at least: damped trend, and 1.4826 times the upper median distance of residuals from their mean.

    A residual is the value less the level before it and the damped trend after it.
    """
    rows = cut(scan(points, holt_step(damp=damp)))
    order = F.struct("at", "sequence")
    ends = rows.groupBy("key").agg(F.max_by(F.col("state")[0] + damp * F.col("state")[1], order).alias("estimate"), F.min(order).alias("start"), F.count("*").alias("n")).where("n > 1")
    told = rows.join(ends.select(F.struct("key").alias("of"), "start"), F.struct("key").eqNullSafe(F.col("of"))).where(F.struct("at", "sequence") != F.col("start"))
    off = told.select("key", (F.col("value") - F.col("before")[0] - damp * F.col("state")[1]).alias("off"))
    centre = off.groupBy("key").agg(F.avg("off").alias("centre"))
    away = off.join(centre.select(F.struct("key").alias("of"), "centre"), F.struct("key").eqNullSafe(F.col("of"))).select("key", F.abs(F.col("off") - F.col("centre")).alias("away"))
    mad = stats.rank_value(away, ["key"], "away", F.floor(F.col("_all") / 2) + 1, "mad")
    scale = F.greatest(F.lit(1e-12), 1.4826 * F.col("mad"))
    both = ends.join(mad.select(F.struct("key").alias("of"), "mad"), F.struct("key").eqNullSafe(F.col("of")))
    return both.select("key", "estimate", (F.col("estimate") - z * scale).alias("lower"), (F.col("estimate") + z * scale).alias("upper"), scale.alias("scale"))
