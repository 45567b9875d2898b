"""Spatial partitions by sort-tile-recursive cuts, joins of boxes by tile, and nearest polygons.

Cuts are fitted on a bounded sample (by hash of the id, so that reruns agree):
it is sorted by x into slabs of equal counts, and each slab by y into tiles.
Tiles cover the plane, so every row has its tiles, whatever the sample saw. A
tile that holds more than ``most`` rows, as copies of one box do that no cut
parts, is dealt over several tasks: its left rows by a salt, its right rows to
each of them. Boxes (id, w, s, e, n) may be in any unit; a box with a null
bound is in no pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .stats import counted

SAMPLE, SIDE = 10_000, 16


def fit(boxes: DataFrame, sample: int = SAMPLE, side: int = SIDE) -> tuple[list[float], list[list[float]]]:
    """Cuts between slabs, and for each slab the cuts between its tiles: less than ``side`` each."""
    middle = boxes.select(((F.col("w") + F.col("e")) / 2.0).alias("x"), ((F.col("s") + F.col("n")) / 2.0).alias("y"), F.xxhash64("id").alias("order")).where("x IS NOT NULL AND y IS NOT NULL")
    rows = middle.orderBy("order", "x", "y").limit(sample).collect()
    xs, ys = np.array([r.x for r in rows], float), np.array([r.y for r in rows], float)
    slabs = max(1, min(side, math.isqrt(len(rows) // 4)))
    share = lambda v: sorted(set(np.quantile(v, np.arange(1, slabs) / slabs, method="lower").tolist())) if len(v) else []
    cuts = share(xs)
    slab = np.searchsorted(cuts, xs, side="right")
    return cuts, [share(ys[slab == k]) for k in range(len(cuts) + 1)]


def _place(cuts: Column, x: Column) -> Column:
    """How many cuts are at most x."""
    return F.aggregate(cuts, F.lit(0), lambda n, c: n + (c <= x).cast("int"))


def _doubles(values: list[float]) -> Column:
    return F.array(*[F.lit(float(c)) for c in values]).cast("array<double>")


def _slab_cuts(cuts: tuple[list[float], list[list[float]]], slab: Column) -> Column:
    return F.element_at(F.array(*[_doubles(c) for c in cuts[1]]), slab + 1)


def tiled(df: DataFrame, cuts: tuple[list[float], list[list[float]]]) -> DataFrame:
    """A row for each tile (slab, tile) that a row's box meets."""
    dealt = df.where("w <= e AND s <= n").withColumn("slab", F.explode(F.sequence(_place(_doubles(cuts[0]), F.col("w")), _place(_doubles(cuts[0]), F.col("e")))))
    within = _slab_cuts(cuts, F.col("slab"))
    return dealt.withColumn("tile", F.explode(F.sequence(_place(within, F.col("s")), _place(within, F.col("n")))))


def join_boxes(left: DataFrame, right: DataFrame, most: int = 100_000, sample: int = SAMPLE, side: int = SIDE) -> DataFrame:
    """Pairs of rows whose boxes meet (borders count), each once: all columns with prefixes l_ and r_.

    Of the tiles that two boxes share, the one with the low corner of what they share tells of the pair.
    """
    cuts = fit(right.select("id", "w", "s", "e", "n").unionByName(left.select("id", "w", "s", "e", "n")) if left.schema["id"].dataType == right.schema["id"].dataType else right, sample, side)
    a, b = tiled(left, cuts), tiled(right, cuts)
    # At most side * side rows come to the driver.
    hot = {(r.slab, r.tile): -(-r["count"] // most) for r in a.groupBy("slab", "tile").count().where(F.col("count") > most).collect()}
    spread = F.coalesce(F.create_map(*[x for (s, t), n in hot.items() for x in (F.lit(s * side + t), F.lit(n))])[F.col("slab") * side + F.col("tile")], F.lit(1)) if hot else F.lit(1)
    a = a.withColumn("salt", F.pmod(F.xxhash64("id"), spread.cast("long")).cast("int"))
    b = b.withColumn("salt", F.explode(F.sequence(F.lit(0), spread - 1)))
    keys = ["slab", "tile", "salt"]
    named = lambda df, p: df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in keys])
    met = named(a, "l").join(named(b, "r"), keys).where("l_w <= r_e AND r_w <= l_e AND l_s <= r_n AND r_s <= l_n")
    home = (_place(_doubles(cuts[0]), F.greatest("l_w", "r_w")) == F.col("slab")) & (_place(_slab_cuts(cuts, F.col("slab")), F.greatest("l_s", "r_s")) == F.col("tile"))
    return met.where(home).drop(*keys)


def _below(points: tuple[np.ndarray, np.ndarray], asked: tuple[np.ndarray, np.ndarray], strict: tuple[bool, bool]) -> np.ndarray:
    """For each (x, y) that is asked, how many points lie at most there in both, or below it where ``strict``.

    Points in order of x hold their places in order of y; a place bit by bit
    (a wavelet matrix) tells how many of the first so many are under a bound.
    """
    (px, py), (qx, qy) = points, asked
    side = ["left" if s else "right" for s in strict]
    hi, bound = np.searchsorted(np.sort(px), qx, side[0]), np.searchsorted(np.sort(py), qy, side[1])
    place = np.empty(len(py), np.int64)
    place[np.argsort(py, kind="stable")] = np.arange(len(py))
    row, lo, count = place[np.argsort(px, kind="stable")], np.zeros(len(qx), np.int64), np.zeros(len(qx), np.int64)
    for bit in reversed(range(len(py).bit_length())):
        one = (row >> bit) & 1 == 1
        zeros = np.concatenate([[0], np.cumsum(~one)])
        up = (bound >> bit) & 1 == 1
        count += np.where(up, zeros[hi] - zeros[lo], 0)
        lo, hi = (np.where(up, zeros[-1] + x - zeros[x], zeros[x]) for x in (lo, hi))
        row = np.concatenate([row[~one], row[one]])
    return count


STRIP_ROWS = 50_000
_BELOW = "id_ {kind}, n_ long"


def _counts_below(rows: DataFrame, by: str, y: str, kind: str) -> DataFrame:
    """id_ and n_ of all that is asked within each group of ``by``: points (id_ null) that lie below it in x and ``y``."""

    def run(g: pa.Table) -> pa.Table:
        corner, point = g.column("corner")[0].as_py(), g.column("point").to_numpy(zero_copy_only=False)
        x, at = g.column("x").to_numpy(), g.column(y).to_numpy()
        n = _below((x[point], at[point]), (x[~point], at[~point]), (corner in (1, 3), y != "y" or corner in (2, 3)))
        return pa.table({"id_": g.column("id_").filter(pa.array(~point)), "n_": pa.array(n * (1 if corner in (0, 3) else -1) * g.column("sign")[0].as_py())})

    return rows.groupBy("sign", "part", "corner", by).applyInArrow(run, _BELOW.format(kind=kind))


def partners(boxes: DataFrame, group: str, strip: int = STRIP_ROWS, few: int = 1000) -> DataFrame:
    """id, n and first: how many boxes (id, w, s, e, n, ``group``) of other groups each box meets, and the least id of these; boxes with none are left out.

    Pairs are not made. Boxes that a box A meets are those with w <= A's e and
    s <= A's n, less those with e < A's w or n < A's s: four counts of corners
    that lie below a point. The plane is cut in strips and slabs of about
    ``strip`` rows; counts within a strip, within a slab over the strips below,
    and of whole cells of slabs and strips before add up to each. What A's own
    group counts is taken off. The least partner is looked for among the ``few``
    least ids, then among four times as many, and so on, by those that have a
    partner and have not found it yet.

    Bounds are whole or double; a box with a null bound or group is in no pair.
    """
    given = cut(boxes.select("id", "w", "s", "e", "n", F.col(group).alias("group")).where("w <= e AND s <= n AND group IS NOT NULL"))
    kind = given.schema["id"].dataType.simpleString()
    size = given.count()
    strips = -(-size // strip)
    shares = [k / strips for k in range(1, strips)]
    cuts = [_doubles(sorted(set(c))) for c in given.approxQuantile(["w", "s"], shares, 0.2 / strips)] if shares else [_doubles([])] * 2
    parts = F.array(F.struct(F.lit(1).alias("sign"), F.lit("").alias("part")), F.struct(F.lit(-1).alias("sign"), F.col("group").cast("string").alias("part")))
    # Corners: 0 (w, s), 1 (e, s), 2 (w, n), 3 (e, n), each asked for at the corner of A that lies across.
    corners = [(("w", "s"), ("e", "n")), (("e", "s"), ("w", "n")), (("w", "n"), ("e", "s")), (("e", "n"), ("w", "s"))]
    row = lambda k, point, c: F.struct(F.lit(k).alias("corner"), F.lit(point).alias("point"), F.col(c[0]).alias("x"), F.col(c[1]).alias("y"))
    rows = given.select("id", "w", "s", "e", "n", F.inline(parts)).select("id", "sign", "part", F.inline(F.array(*[row(k, point, c[not point]) for k, c in enumerate(corners) for point in (True, False)])))
    rows = cut(rows.select(F.when(~F.col("point"), F.col("id")).alias("id_"), "sign", "part", "corner", "point", "x", "y", _place(cuts[0], F.col("x")).alias("slab"), _place(cuts[1], F.col("y")).alias("strip")))
    cells = rows.where("point").groupBy("sign", "part", "corner", "slab", "strip").agg(F.count("*").alias("m"))
    every = cells.select("sign", "part", "corner").distinct().withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(strips)))).withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(strips))))
    before = lambda over, along: Window.partitionBy("sign", "part", "corner", over).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    keys = ["sign", "part", "corner", "slab", "strip"]
    whole = every.join(cells, keys, "left").withColumn("m", F.sum("m").over(before("slab", "strip"))).withColumn("m", F.coalesce(F.sum("m").over(before("strip", "slab")), F.lit(0)))
    signed = F.when(F.col("corner").isin(0, 3), 1).otherwise(-1) * F.col("sign") * F.col("m")
    told = rows.where("NOT point").join(whole, keys).select("id_", signed.alias("n_"))
    told = told.unionByName(_counts_below(rows, "strip", "y", kind)).unionByName(_counts_below(rows, "slab", "strip", kind))
    counts = cut(told.groupBy(F.col("id_").alias("id")).agg(F.sum("n_").alias("n")).where("n > 0"))

    ranked = cut(given.join(counted(given, [], "id").select("id", F.col("_before").alias("rank")), "id"))
    rest, found, begin = cut(given.join(counts, "id", "left_semi")), None, 0
    while begin < size and not rest.isEmpty():
        some = ranked.where((F.col("rank") >= begin) & (F.col("rank") < begin + few)).drop("rank")
        new = cut(join_boxes(rest, some).where("l_group <> r_group").groupBy(F.col("l_id").alias("id")).agg(F.min("r_id").alias("first")))
        found = new if found is None else found.unionByName(new)
        rest = cut(rest.join(new, "id", "left_anti"))
        begin, few = begin + few, few * 4
    first = found if found is not None else given.select("id", F.col("id").alias("first")).limit(0)
    return counts.join(first, "id").select("id", "n", "first")


def distances(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """t, x, y, id and the plane distance from each point to its polygon, 0 inside: of pairs (t, x, y, id) and edges (id, x1, y1, x2, y2)."""
    dx, dy = (F.col("x2") - F.col("x1")).cast("double"), (F.col("y2") - F.col("y1")).cast("double")
    along = ((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy) / (dx * dx + dy * dy)
    on = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    far = F.hypot(F.col("x") - F.col("x1") - on * dx, F.col("y") - F.col("y1") - on * dy)
    west = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < F.col("x1") + (F.col("y") - F.col("y1")) * (dx / dy))
    per = pairs.join(edges, "id").groupBy("t", "x", "y", "id").agg(F.min(far).alias("far"), F.sum(west.cast("int")).alias("west"))
    return per.select("t", "x", "y", "id", F.when(F.col("west") % 2 == 1, 0.0).otherwise(F.col("far")).alias("far"))


def nearest(points: DataFrame, edges: DataFrame, boxes: DataFrame, k: int, start: float) -> DataFrame:
    """The k nearest polygons of each point (t, x, y): t, id, far, place; ids break ties.

    A polygon is no nearer than its box, so a round looks at the boxes within
    a radius, and a point is done when its k-th is within it; the others look
    four times as far, until the radius spans all boxes and points.
    """
    reach = boxes.agg(F.min("w"), F.min("s"), F.max("e"), F.max("n")).first()
    around = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if reach[0] is None or around[0] is None:
        return points.select("t", F.lit(None).cast(boxes.schema["id"].dataType).alias("id"), F.lit(0.0).alias("far"), F.lit(0).alias("place")).limit(0)
    whole = sum(max(reach[i + 2], around[i + 2]) - min(reach[i], around[i]) for i in (0, 1)) + 1.0
    rest, out, radius = cut(points.select("t", "x", "y").where("x IS NOT NULL AND y IS NOT NULL")), None, start
    order = Window.partitionBy("t").orderBy("far", "id")
    while True:
        last = radius >= whole
        looking = rest.select(F.col("t").alias("id"), "x", "y", (F.col("x") - radius).alias("w"), (F.col("y") - radius).alias("s"), (F.col("x") + radius).alias("e"), (F.col("y") + radius).alias("n"))
        pairs = join_boxes(looking, boxes).select(F.col("l_id").alias("t"), F.col("l_x").alias("x"), F.col("l_y").alias("y"), F.col("r_id").alias("id"))
        near = distances(pairs, edges).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
        found = cut(near if last else near.where(F.col("far") <= radius))
        done = found if last else found.join(found.where(F.col("place") == k).select("t"), "t", "left_semi")
        done = done.select("t", "id", "far", "place")
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        rest = cut(rest.join(done.select("t").distinct(), "t", "left_anti"))
        if rest.isEmpty():
            return out
        radius *= 4
