"""Shock propagation along time-valid edges, continuity trajectories, counterfactuals.

Every simple path carries a signal of its own; signals meet only at the end,
where each entity's are aggregated. An edge must be active when a signal
leaves and, with its delay, when it arrives. Signals below ``least`` end.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_number
from ..plans.lineage import cut, written
from .temporal import active_at


def attenuation(effects: DataFrame) -> DataFrame:
    """entity, keep = (1 - largest reduction) * (1 - largest gain) of effects (entity, reduction, gain)."""
    per = effects.groupBy("entity").agg(F.max("reduction").alias("r"), F.max("gain").alias("g"))
    return per.select("entity", ((1 - F.coalesce("r", F.lit(0.0))) * (1 - F.coalesce("g", F.lit(0.0)))).alias("keep"))


FEW = 50_000


def _beside(signals: DataFrame, n: int) -> DataFrame:
    """Signals as one side of a join with edges: up to FEW of them, whose number is known, go to the edges, so that these are not shuffled for every hop."""
    return F.broadcast(signals) if n <= FEW else signals


LEVELS = 4
# Edges, or a function that makes them: all of them or, of few entities (src), all that leave these.
Edges = DataFrame | Callable[..., DataFrame]


def _leaving(edges: Edges, made: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], DataFrame]:
    """A function that gives, for ``n`` signals, ``made`` edges among which are all that leave their entities.

    Up to FEW signals ask for theirs: ``edges`` makes them or, if it is a
    DataFrame, a semi-join seeks them, which Spark carries below an aggregate on
    src. So all rows are read, and those of these entities alone are shuffled.
    For more signals, or when it is asked more than LEVELS times, all edges are
    made once and kept.
    """
    asked, whole = 0, None

    def of(signals: DataFrame, n: int) -> DataFrame:
        nonlocal asked, whole
        asked += 1
        if whole is None and (n > FEW or asked > LEVELS):
            whole = written(made(_every(edges)), "edges")
        if whole is not None:
            return whole
        src = signals.select(F.col("entity").alias("src"))
        return made(edges(src) if callable(edges) else edges.join(F.broadcast(src), "src", "left_semi"))

    return of


def _every(edges: Edges) -> DataFrame:
    return edges() if callable(edges) else edges


MOST_DELAY = 10 * 366 * 86400.0


def edge_delay(latency: Column, delay: Column, travel_time: Column, default: float = 0.0, most: float = MOST_DELAY) -> Column:
    """Seconds that an edge takes: the first of its attributes that is there, else the default; an error outside of 0 .. ``most``."""
    first = F.coalesce(latency, delay, travel_time, F.lit(default)).cast("double")
    return F.when((first >= 0) & (first <= most), first).otherwise(F.raise_error(F.lit("a delay is outside of its bounds")).cast("double"))


def propagate(edges: Edges, shocks: DataFrame, keep: DataFrame | None = None, least: float = 0.01, hops: int = 32, delay_seconds: float = 0.0, variant: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Signals: shock_id, entity, impairment, depth, effective_at, path.

    ``edges`` has src, dst, factor, valid_from, valid_to, and may have delay
    (seconds, see ``edge_delay``; else ``delay_seconds`` holds for all) and
    kind, of which ``kinds`` are allowed (None: all); it may be a function, as
    ``Edges`` says. ``keep`` scales the
    impairment on arrival at an entity, at the source too. ``variant`` columns
    of shocks (and keep) are carried along, so several worlds run as one plan.
    """
    variant = variant or []

    def made(df: DataFrame) -> DataFrame:
        df = df if kinds is None else df.where(F.col("kind").isin(kinds))
        delay = F.col("delay") if "delay" in df.columns else F.lit(delay_seconds)
        return df.select("src", "dst", "factor", "valid_from", "valid_to", F.make_dt_interval(secs=delay.cast("decimal(18,6)")).alias("wait"))

    leaving = _leaving(edges, made)
    keep = None if keep is None else cut(keep)
    wait = F.col("wait")

    def damp(df: DataFrame) -> DataFrame:
        if keep is None:
            return df
        return df.join(keep, [*variant, "entity"], "left").withColumn("impairment", F.col("impairment") * F.coalesce("keep", F.lit(1.0))).drop("keep")

    start = shocks.select(*variant, "shock_id", F.col("source").alias("entity"), F.col("severity").cast("double").alias("impairment"), F.lit(0).alias("depth"), F.col("starts_at").alias("effective_at"), F.array("source").alias("path"))
    frontier = cut(damp(start).where(F.col("impairment") >= least))
    every, n = frontier, frontier.count()
    for _ in range(hops):
        out = _beside(frontier, n).join(leaving(frontier, n), (F.col("entity") == F.col("src")) & ~F.array_contains("path", F.col("dst")))
        out = out.where(active_at(F.col("effective_at")) & active_at(F.col("effective_at") + wait))
        out = out.select(*variant, "shock_id", F.col("dst").alias("entity"), (F.col("impairment") * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("factor")))).alias("impairment"), (F.col("depth") + 1).alias("depth"), (F.col("effective_at") + wait).alias("effective_at"), F.concat("path", F.array("dst")).alias("path"))
        frontier = cut(damp(out).where(F.col("impairment") >= least))
        n = frontier.count()
        if n == 0:
            break
        every = every.unionByName(frontier)
    return every


QUIESCENT, NOTHING = "quiescent", "all initial signals below minimum impairment"
SIGNALS_REACHED, PATHS_REACHED = "max_signals reached", "max_paths_per_entity reached"
ORDER = ["effective_at", "depth", "shock_id", "entity", "via", "path"]


@dataclass(frozen=True)
class Outcome:
    """How a bounded run ended: status (complete, truncated, no_initial_signal), reason, signals processed and generated."""

    status: str
    reason: str
    processed: int
    generated: int


def propagate_bounded(edges: Edges, shocks: DataFrame, keep: DataFrame | None = None, least: float = 0.01, hops: int = 32, max_signals: int = 100_000, paths_an_entity: int = 64) -> tuple[DataFrame, Outcome]:
    """Signals as of ``propagate``, in best-first order and within bounds, and how the run ended.

    Signals are processed in ORDER: by time, depth, shock, entity and path. A
    processed signal generates one along each edge, in order of edge_id; an
    entity keeps the first ``paths_an_entity`` generated for it, and the run
    ends after ``max_signals`` processed ones. Edges have edge_id besides what
    ``propagate`` takes; ``via`` holds those of a path.

    A round takes all signals that nothing still to come can precede: those
    earlier than the first by less than the least delay of an edge or, if some
    edge takes no time, those of the first time and depth. Within a round
    signals are ranked for each entity, counts of earlier rounds come by a
    join, and the last round alone is cut in global order, by the first
    ``max_signals`` rows at most. So the result is that of one sequential
    queue, whatever the partitions.
    """

    def made(df: DataFrame) -> DataFrame:
        delay = F.col("delay") if "delay" in df.columns else F.lit(0.0)
        return df.select("edge_id", "src", "dst", "factor", "valid_from", "valid_to", delay.cast("double").alias("delay"), F.make_dt_interval(secs=delay.cast("decimal(18,6)")).alias("wait"))

    ahead, leaving = 0.0, _leaving(edges, made)
    if "delay" in _every(edges).columns:  # the least delay asks for all edges, which are kept then
        whole = written(made(_every(edges)), "edges")
        ahead, leaving = whole.agg(F.min("delay")).first()[0] or 0.0, lambda signals, n: whole
    keep = None if keep is None else cut(keep)

    def damp(df: DataFrame) -> DataFrame:
        if keep is None:
            return df
        return df.join(keep, "entity", "left").withColumn("impairment", F.col("impairment") * F.coalesce("keep", F.lit(1.0))).drop("keep")

    columns = ["shock_id", "entity", "impairment", "depth", "effective_at", "path", "via"]
    start = shocks.select("shock_id", F.col("source").alias("entity"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("severity").cast("double"))).alias("impairment"), F.lit(0).alias("depth"), F.col("starts_at").alias("effective_at"), F.array("source").alias("path"), F.array().cast("array<string>").alias("via"))
    new = cut(damp(start).where(F.col("impairment") >= least).select(*columns, F.struct("effective_at", "shock_id").alias("turn")))
    held, frontier, every = None, None, None
    processed = generated = 0
    reason = QUIESCENT
    while True:
        # The first in turn of each entity, as long as it has room.
        first = Window.partitionBy("entity").orderBy("turn")
        some = new.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= paths_an_entity)
        if held is not None:
            some = some.join(held, "entity", "left").where(F.col("_n") + F.coalesce("held", F.lit(0)) <= paths_an_entity)
        some = cut(some.select(*columns))
        coming, kept = new.count(), some.count()
        generated += kept
        if kept < coming:
            reason = PATHS_REACHED
        counts = some.groupBy("entity").agg(F.count("*").alias("held"))
        held = cut(counts if held is None else held.unionByName(counts).groupBy("entity").agg(F.sum("held").alias("held")))
        every = some if every is None else every.unionByName(some)
        frontier = some if frontier is None else cut(frontier.unionByName(some))
        head = frontier.agg(F.min(F.struct("effective_at", "depth")).alias("h")).first().h
        if head is None:
            break
        if processed >= max_signals:
            reason = SIGNALS_REACHED
            break
        begin = F.lit(head.effective_at)
        ready = F.col("effective_at") < begin + F.make_dt_interval(secs=F.lit(ahead).cast("decimal(18,6)")) if ahead > 0 else (F.col("effective_at") == begin) & (F.col("depth") == head.depth)
        batch, rest = frontier.where(ready), frontier.where(~ready)
        size = batch.count()
        if processed + size > max_signals:
            batch = cut(batch.orderBy(*ORDER).limit(max_signals - processed))
            rest = frontier.join(batch.select("shock_id", "via", "path"), ["shock_id", "via", "path"], "left_anti").select(*columns)
            size = max_signals - processed
        processed += size
        batch = batch.where(F.col("depth") < hops).select(*columns, F.struct(*ORDER).alias("turn"))
        out = _beside(batch, size).join(leaving(batch, size), (F.col("entity") == F.col("src")) & ~F.array_contains("path", F.col("dst")))
        out = out.where(active_at(F.col("effective_at")) & active_at(F.col("effective_at") + F.col("wait")) & (F.col("factor") > 0))
        out = out.select("shock_id", F.col("dst").alias("entity"), (F.col("impairment") * F.least(F.lit(1.0), F.col("factor"))).alias("impairment"), (F.col("depth") + 1).alias("depth"), (F.col("effective_at") + F.col("wait")).alias("effective_at"), F.concat("path", F.array("dst")).alias("path"), F.concat("via", F.array("edge_id")).alias("via"), F.struct("turn", "edge_id").alias("turn"))
        new = cut(damp(out).where(F.col("impairment") >= least).select(*columns, "turn"))
        frontier = rest
    status = "no_initial_signal" if not generated else "complete" if reason == QUIESCENT else "truncated"
    return every, Outcome(status, reason if generated else NOTHING, processed, generated)


@dataclass(frozen=True)
class Rules:
    """The settings of a propagation; ``check`` refuses what is out of bounds, ``digest`` names them."""

    least: float = 0.01
    hops: int = 32
    aggregation: str = "max"
    delay_seconds: float = 0.0
    most_delay: float = MOST_DELAY
    least_factor: float = 0.0
    kinds: tuple[str, ...] | None = None

    def check(self) -> Rules:
        if not all(map(math.isfinite, (self.least, self.delay_seconds, self.most_delay, self.least_factor))):
            raise ValueError("settings must be finite")
        if not (0 < self.least <= 1 and self.hops >= 0 and 0 <= self.delay_seconds <= self.most_delay and 0 <= self.least_factor <= 1):
            raise ValueError("settings are out of bounds")
        if self.aggregation not in ("max", "sum_cap", "noisy_or"):
            raise ValueError("no such aggregation")
        return self

    def mapping(self) -> dict:
        return asdict(self.check()) | {"kinds": None if self.kinds is None else list(self.kinds)}

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(self.mapping(), sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def allows(self, kind: Column) -> Column:
        return F.lit(True) if self.kinds is None else F.coalesce(kind.isin(*self.kinds), F.lit(False))

    def factor(self, strength: Column, capacity: Column, explicit: Column | None = None) -> Column:
        """Share of an impairment that an edge passes on, within 0 .. 1; nothing below ``least_factor``."""
        x = strength * capacity if explicit is None else strength * capacity * F.coalesce(explicit, F.lit(1.0))
        held = F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
        return F.when(held < self.least_factor, 0.0).otherwise(held)

    def run(self, edges: Edges, shocks: DataFrame, keep: DataFrame | None = None) -> DataFrame:
        self.check()
        return propagate(edges, shocks, keep, self.least, self.hops, self.delay_seconds, kinds=None if self.kinds is None else list(self.kinds))


def outcome(signals: DataFrame) -> DataFrame:
    """One row on a run: status, n, entities, shocks, depth, impairment; no_initial_signal where nothing set out."""
    return signals.agg(
        F.when(F.count("*") == 0, "no_initial_signal").otherwise("complete").alias("status"), F.count("*").alias("n"), F.count_distinct("entity").alias("entities"), F.count_distinct("shock_id").alias("shocks"),
        F.coalesce(F.max("depth"), F.lit(0)).alias("depth"), F.coalesce(F.max("impairment"), F.lit(0.0)).alias("impairment"),
    )


def state_digest(states: DataFrame, by: list[str]) -> DataFrame:
    """Digest of the states (entity, capacity) of each group, whatever their order: a sum of hashes, hashed, so no task collects them."""
    one = hash_number(F.col("entity"), F.round(F.col("capacity") * 1000000).cast("long"))
    return states.groupBy(*by).agg(F.count("*").alias("n"), F.sum(one.cast("decimal(38,0)")).alias("_sum")).withColumn("digest", F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("_sum").cast("string")), 256)).drop("_sum")


def noisy_or(column: str) -> Column:
    return 1 - F.product(1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(column))))


def capacities(signals: DataFrame, how: str = "max", by: list[str] | None = None) -> DataFrame:
    """entity, impairment, n, of all its signals together: max, sum_cap or noisy_or."""
    x = {"max": F.max("impairment"), "sum_cap": F.least(F.lit(1.0), F.sum("impairment")), "noisy_or": noisy_or("impairment")}[how]
    return signals.groupBy(*(by or []), "entity").agg(x.alias("impairment"), F.count("*").alias("n"))


def strongest(signals: DataFrame) -> DataFrame:
    """The best signal of each entity: largest impairment, least depth, earliest, first path."""
    w = Window.partitionBy("entity").orderBy(F.desc("impairment"), "depth", "effective_at", "path")
    return signals.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def trajectory(impairments: DataFrame, hours: int, recovery_hours: int, steps: int = 8) -> DataFrame:
    """entity, hour, capacity: impaired for ``hours``, then linear recovery in ``steps`` steps."""
    point = F.explode(F.expr(f"concat(array(named_struct('h', 0.0D, 'f', 0.0D), named_struct('h', {float(hours)}D, 'f', 0.0D)), transform(sequence(1, {steps}), i -> named_struct('h', {float(hours)}D + {float(recovery_hours)}D * i / {steps}, 'f', i / {float(steps)}D)))"))
    return impairments.select("entity", "impairment", point.alias("p")).select("entity", F.col("p.h").alias("hour"), (1 - F.col("impairment") * (1 - F.col("p.f"))).alias("capacity"))


def continuity(points: DataFrame, threshold: float, baseline: float = 1.0) -> DataFrame:
    """Per entity: least capacity, hours below the threshold, capacity-hours, deficit-hours, resilience, first hour at the threshold."""
    w = Window.partitionBy("entity").orderBy("hour", "capacity")
    a, b, dt = F.col("capacity"), F.col("b"), F.col("dt")
    below = F.when((a < threshold) & (b < threshold), dt).when((a < threshold) & (b >= threshold), dt * (threshold - a) / (b - a)).when((a >= threshold) & (b < threshold), dt * (threshold - b) / (a - b)).otherwise(0.0)
    seg = points.withColumns({"b": F.lead("capacity").over(w), "dt": F.lead("hour").over(w) - F.col("hour")})
    whole = F.sum(dt)
    return seg.groupBy("entity").agg(
        F.min("capacity").alias("least"), F.sum(below).alias("hours_below"), F.sum(dt * (a + b) / 2).alias("capacity_hours"), F.sum(dt * F.greatest(F.lit(0.0), baseline - (a + b) / 2)).alias("deficit_hours"),
        (F.sum(dt * (a + b) / 2) / (baseline * whole)).alias("resilience"), F.min(F.when(a >= threshold, F.col("hour"))).alias("hours_to_threshold"),
    )


def recovery_points(initial: Column, target: float, hours: float, rate_per_hour: float | None = None, steps: int = 8) -> Column:
    """Array of (hour, capacity): linear from initial to target, or exponential towards it by a rate."""
    def point(i: Column) -> Column:
        share = i / F.lit(float(steps))
        rest = 1 - share if rate_per_hour is None else F.exp(-F.lit(rate_per_hour) * share * hours)
        return F.struct((share * hours).alias("hour"), (F.lit(target) - (F.lit(target) - initial) * rest).alias("capacity"))

    return F.transform(F.sequence(F.lit(0), F.lit(steps)), point)


def change(before: Column, after: Column) -> Column:
    """Relative change: 0/0 is 0, and anything else over 0 is infinite."""
    return F.when((before == 0) & (after == 0), 0.0).when(before == 0, F.lit(float("inf"))).otherwise((after - before) / before)


def fold_patches(patches: DataFrame, default: float = 1.0) -> DataFrame:
    """entity, capacity after patches (entity, seq, op, amount) in order, within 0..1.

    Ops are set, add, multiply, min, max, and remove, which brings back the default.
    """
    steps = F.array_sort(F.collect_list(F.struct("seq", "op", "amount")))

    def apply(value: Column, p: Column) -> Column:
        new = F.when(p.op == "set", p.amount).when(p.op == "remove", F.lit(default)).when(p.op == "add", value + p.amount).when(p.op == "multiply", value * p.amount).when(p.op == "min", F.least(value, p.amount)).when(p.op == "max", F.greatest(value, p.amount)).otherwise(value)
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), new))

    return patches.groupBy("entity").agg(steps.alias("steps")).select("entity", F.aggregate("steps", F.lit(default), apply).alias("capacity"))
