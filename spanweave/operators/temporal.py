"""Half-open validity, bitemporal selection, as-of and interval joins, calendar steps.

A null bound is open. Intervals are [start, end): what ends at an instant is
not valid at it, and intervals that touch do not overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import stats

GRAINS = {"microsecond": 1, "millisecond": 10**3, "second": 10**6, "minute": 6 * 10**7, "hour": 36 * 10**8, "day": 864 * 10**8, "week": 7 * 864 * 10**8}
MONTHS = {"month": 1, "quarter": 3, "year": 12}


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def active_at(at: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    return (F.col(start).isNull() | (F.col(start) <= at)) & (F.col(end).isNull() | (at < F.col(end)))


def overlaps(begin: Column, stop: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    return (F.col(end).isNull() | (F.col(end) > begin)) & (F.col(start).isNull() | (F.col(start) < stop))


def whole_window(begin: Column, stop: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    return (F.col(start).isNull() | (F.col(start) <= begin)) & (F.col(end).isNull() | (F.col(end) >= stop))


def as_of(versions: DataFrame, valid_at: Column | None, known_at: Column) -> DataFrame:
    """Of each record the version last known at ``known_at`` and, if given, valid at ``valid_at``; the larger id wins ties."""
    rows = versions.where(F.col("known_from").isNull() | (F.col("known_from") <= known_at))
    if valid_at is not None:
        rows = rows.where(active_at(valid_at))
    order = Window.partitionBy("record_key").orderBy(F.col("known_from").desc_nulls_last(), F.col("version_id").desc())
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def nearest_point(probes: DataFrame, points: DataFrame, before: bool = True) -> DataFrame:
    """As-of join: to each probe (key, at, ...) the last point at or before it, or the first at or after.

    Probes and points are sorted together by key and time, and a window carries
    the last point on: one shuffle, no pairs. ``points`` has key, at, sequence, value.
    """
    fields = F.struct(F.col("at").alias("point_at"), "sequence", "value")
    rows = points.select("key", "at", F.lit(0).alias("_probe"), "sequence", fields.alias("_point"))
    empty = rows.schema["_point"].dataType.simpleString()
    rest = [c for c in probes.columns if c not in ("key", "at")]
    asked = probes.select("key", "at", F.lit(1 if before else -1).alias("_probe"), F.lit(None).cast(points.schema["sequence"].dataType).alias("sequence"), F.lit(None).cast(empty).alias("_point"), *rest)
    both = rows.select("*", *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in rest]).unionByName(asked)
    order = [F.col(c).asc_nulls_last() if before else F.col(c).desc_nulls_last() for c in ("at", "_probe", "sequence")]
    w = Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_point", ignorenulls=True).over(w)).where(F.col("_probe") != 0)
    return found.select("key", "at", *rest, "_found.point_at", "_found.sequence", "_found.value")


def interval_join(left: DataFrame, right: DataFrame, width_days: int, on: list[str] | None = None) -> DataFrame:
    """Pairs of rows (id, s, e) with a common instant, with their intersection.

    Both sides are dealt to the buckets of time that they touch and joined on
    them; a pair counts in the first bucket both are in, so it comes up once. A
    null bound is open: it is dealt as far as bounds go on either side, which
    one small aggregate tells, and is null in the intersection if open in both.
    """
    edges = left.select("s", "e").unionByName(right.select("s", "e")).agg(F.least(F.min("s"), F.min("e")), F.greatest(F.max("s"), F.max("e"))).first()
    kind = left.schema["s"].dataType
    low, high = (F.lit(x).cast(kind) if x is not None else F.lit("2000-01-01").cast(kind) for x in edges)
    low, high = low - F.expr("interval 1 day"), high + F.expr("interval 1 day")

    def dealt(df: DataFrame, tag: str) -> DataFrame:
        day = lambda c: F.floor(F.unix_date(F.to_date(c)) / width_days)
        start, end = F.coalesce("s", low), F.coalesce("e", high)
        last = day(end - F.expr("interval 1 microsecond"))
        return df.select(*(on or []), *[F.col(c).alias(f"{tag}_{c}") for c in df.columns if c not in (on or [])], start.alias(f"{tag}_from"), end.alias(f"{tag}_to"), day(start).alias(f"{tag}_b"), F.explode(F.sequence(day(start), F.greatest(day(start), last))).alias("_bucket"))

    both = dealt(left, "l").join(dealt(right, "r"), [*(on or []), "_bucket"])
    hit = (F.col("l_from") < F.col("r_to")) & (F.col("r_from") < F.col("l_to")) & (F.col("_bucket") == F.greatest("l_b", "r_b"))
    return both.where(hit).drop("_bucket", "l_b", "r_b", "l_from", "r_from", "l_to", "r_to").withColumns({"s": F.greatest("l_s", "r_s"), "e": F.least("l_e", "r_e")})


def allen(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Which of Allen's thirteen relations a pair of intervals has."""
    return (
        F.when(a1 < b0, "before").when(a1 == b0, "meets").when(b1 < a0, "after").when(b1 == a0, "met_by")
        .when((a0 == b0) & (a1 == b1), "equals").when((a0 == b0) & (a1 < b1), "starts").when(a0 == b0, "started_by")
        .when((a1 == b1) & (a0 > b0), "finishes").when(a1 == b1, "finished_by")
        .when((a0 > b0) & (a1 < b1), "during").when((a0 < b0) & (a1 > b1), "contains").when(a0 < b0, "overlaps").otherwise("overlapped_by")
    )


RELATIONS = {"before": "after", "meets": "met_by", "starts": "started_by", "finishes": "finished_by", "during": "contains", "overlaps": "overlapped_by"}


def allen_counts(intervals: DataFrame, key: str) -> DataFrame:
    """key, relation, n: how many ordered pairs of two intervals (key, s, e) of a key are in each of Allen's relations.

    No pairs are made. Ends before a start, shared endpoints and equal
    intervals are sums over endpoints in order. Intervals within another are
    counted bit by bit of the rank of their starts: of two ranks that share all
    higher bits and differ in one, the one with the 0 starts earlier, and
    running sums over the ends of such a group count those that end later. So a
    key with n intervals costs n log n rows, dealt by range, whatever its share
    of all. What is left of all pairs overlaps.

    Intervals without s < e are left out; a null key is none.
    """
    given = cut(intervals.select(F.col(key).alias("key"), "s", "e").where("key IS NOT NULL AND s < e").groupBy("key", "s", "e").agg(F.count("*").alias("m")))
    ends = given.select("key", F.col("s").alias("t"), F.col("m").alias("starts"), F.lit(0).cast("long").alias("stops")).unionByName(given.select("key", F.col("e").alias("t"), F.lit(0).cast("long").alias("starts"), F.col("m").alias("stops")))
    times = stats.running(ends.groupBy("key", "t").agg(F.sum("starts").alias("starts"), F.sum("stops").alias("stops")), ["key"], "t", ["stops"])
    apart = times.groupBy("key").agg(F.sum(F.col("starts") * F.col("before_stops")).alias("before"), F.sum(F.col("starts") * F.col("stops")).alias("meets"))
    square = lambda c: F.sum(F.col(c) * F.col(c))
    one = lambda c: given.groupBy("key", c).agg(F.sum("m").alias("k")).groupBy("key").agg(square("k").alias(f"same_{c}"))
    same = given.groupBy("key").agg(square("m").alias("same"), F.sum("m").alias("size"))
    ranks = stats.counted(given, ["key"], "s").select("key", "s", F.col("_before").alias("rank"))
    bits = int(ranks.agg(F.max("rank")).first()[0] or 0).bit_length()
    placed = given.join(ranks, ["key", "s"]).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(max(0, bits - 1)))))
    bit = F.expr("(rank >> level) & 1")
    sides = placed.select("key", "level", F.expr("rank >> (level + 1)").alias("prefix"), "e", F.when(bit == 0, F.col("m")).otherwise(0).alias("early"), F.when(bit == 1, F.col("m")).otherwise(0).alias("late"))
    groups = sides.groupBy("key", "level", "prefix", "e").agg(F.sum("early").alias("early"), F.sum("late").alias("late"))
    within = stats.running(groups, ["key", "level", "prefix"], "e", ["early"], descending=True).groupBy("key").agg(F.sum(F.col("late") * F.col("before_early")).alias("during"))
    told = same.join(apart, "key").join(one("s"), "key").join(one("e"), "key").join(within, "key")
    half = lambda c: ((F.col(c) - F.col("same")) / 2).cast("long")
    told = told.select("key", "before", "meets", half("same_s").alias("starts"), half("same_e").alias("finishes"), "during", (F.col("same") - F.col("size")).alias("equals"), "size")
    rest = ((F.col("size") * (F.col("size") - 1) - F.col("equals")) / 2).cast("long") - F.col("before") - F.col("meets") - F.col("starts") - F.col("finishes") - F.col("during")
    told = told.withColumn("overlaps", rest)
    both = F.array(F.struct(F.lit("equals").alias("relation"), F.col("equals").alias("n")), *[F.struct(F.lit(name).alias("relation"), F.col(c).alias("n")) for c, back in RELATIONS.items() for name in (c, back)])
    return told.select("key", F.inline(both)).where("n > 0").select(F.col("key").alias(key), "relation", "n")


def floor_to(at: Column, grain: str) -> Column:
    """Start of the calendar unit that holds an instant; weeks begin on Monday."""
    return F.date_trunc(grain, at).cast("timestamp_ntz")


def step(at: Column, grain: str, count: Column | int) -> Column:
    """So many units later; months clamp to the end of a shorter one."""
    count = F.lit(count) if isinstance(count, int) else count
    if grain in MONTHS:
        return at + F.make_ym_interval(F.lit(0), (count * MONTHS[grain]).cast("int"))
    return at + F.make_dt_interval(secs=(count * F.lit(GRAINS[grain])).cast("decimal(18,0)") / F.lit(10**6))


def bucket(at: Column, grain: str) -> tuple[Column, Column]:
    start = floor_to(at, grain)
    return start, step(start, grain, 1)
