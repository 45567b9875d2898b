"""Scenario trees, task graphs and schedules: small control structures beside the data."""

from __future__ import annotations

import heapq
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut


@dataclass(frozen=True)
class Task:
    name: str
    run: Callable[[dict], object]
    after: tuple[str, ...] = ()
    retries: int = 0
    wait_seconds: float = 0.0


class Pipeline:
    """Tasks in an order that respects ``after``, least names first; a cycle or an unknown name is an error."""

    def __init__(self, tasks: list[Task]):
        self.tasks = {t.name: t for t in tasks}
        if len(self.tasks) < len(tasks):
            raise ValueError("task names must differ")
        self.order = self._order()

    def _order(self) -> list[str]:
        left = {n: set(t.after) for n, t in self.tasks.items()}
        if unknown := set().union(*left.values()) - set(left) if left else set():
            raise ValueError(f"unknown tasks: {sorted(unknown)}")
        ready = [n for n, a in left.items() if not a]
        heapq.heapify(ready)
        out = []
        while ready:
            name = heapq.heappop(ready)
            out.append(name)
            for other, after in left.items():
                if name in after:
                    after.remove(name)
                    if not after:
                        heapq.heappush(ready, other)
        if len(out) < len(left):
            raise ValueError("the tasks have a cycle")
        return out

    def execute(self) -> dict:
        results: dict = {}
        for name in self.order:
            task = self.tasks[name]
            for attempt in range(task.retries + 1):
                try:
                    results[name] = task.run(results)
                    break
                except Exception:
                    if attempt == task.retries:
                        raise
                    time.sleep(task.wait_seconds * 2**attempt)
        return results


@dataclass
class Schedule:
    """Runs of an interval since a start; ``due`` gives those not yet given."""

    start: datetime
    every: timedelta
    given: datetime | None = field(default=None)

    def due(self, now: datetime) -> Iterator[datetime]:
        at = self.start if self.given is None else self.given + self.every
        while at <= now:
            self.given = at
            yield at
            at += self.every


def tree_problems(branches: DataFrame) -> DataFrame:
    """node, problem of a scenario tree (node, parent): several parents, unknown parents, or no way up to a root."""
    many = branches.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node", F.lit("several parents").alias("problem"))
    known = branches.select(F.col("node").alias("parent")).distinct()
    lost = branches.where("parent is not null").join(known, "parent", "left_anti").select("node", F.lit("unknown parent").alias("problem"))
    reached = cut(branches.where("parent is null").select("node").distinct())
    frontier = reached
    while not frontier.isEmpty():
        below = branches.join(frontier.select(F.col("node").alias("parent")), "parent").select("node").distinct()
        frontier = cut(below.join(reached, "node", "left_anti"))
        reached = cut(reached.unionByName(frontier))
    loose = branches.select("node").distinct().join(reached, "node", "left_anti").select("node", F.lit("no root").alias("problem"))
    return many.unionByName(lost).unionByName(loose)


def walk_tree(branches: DataFrame, most: int = 64) -> DataFrame:
    """node, depth, path of the nodes whose guards, and all those above them, hold (node, parent, holds)."""
    every = cut(branches.where("parent is null and holds").select("node", F.lit(0).alias("depth"), F.array("node").alias("path")))
    frontier = every
    for _ in range(most):
        up = frontier.select(F.col("node").alias("parent"), F.col("depth"), F.col("path"))
        frontier = cut(branches.where("holds").join(up, "parent").where(~F.array_contains("path", F.col("node"))).select("node", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("node")).alias("path")))
        if frontier.isEmpty():
            break
        every = every.unionByName(frontier)
    return every
