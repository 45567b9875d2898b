"""Planar overlay of polygons on longitude and latitude: intersections, unions, differences, repair and relations.

Polygons are rows of rings (id, ring: array of (lat, lon)); several rings of
one id are taken together by the even-odd rule, so holes, parts and rings that
cross themselves need no case of their own. Coordinates are whole numbers of
GRID degrees. Edges are rows: they meet by a join on grid cells, are cut where
they meet, and each piece asks by a join on bands of latitude how many edges of
each polygon lie west of it. So every piece knows which polygons lie to its
left and to its right, and a result of any kind keeps the pieces with the
result on one side only. Nothing holds a whole polygon but a row that came
with one and ``rings``, which links the pieces of one result.

A ring that crosses the antimeridian is unrolled: its longitudes go on past
180. ``pairs`` brings polygons together that meet after a turn of 360 degrees,
too. A ring around a pole has no inside on this plane and is not supported.
Repeated corners and rings of fewer than three corners have no edges. A
coordinate that is null makes its two edges void.

Cells and bands are as wide as the median edge, and at most MOST_CELLS wide
and high for one edge, longer edges being cut first.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .tiles import join_boxes

GRID = 1e-9
TURN = 360 * 10**9
MOST_CELLS = 64
POINT = ("x1", "y1", "x2", "y2")


def _whole(x: Column) -> Column:
    return F.round(x / GRID).cast("long")


def unrolled(ring: Column) -> Column:
    """The ring as whole (x, y), its longitudes continuous: 360 more after each step of over 180 to the west, less after one to the east."""
    near = F.zip_with(ring, F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda a, b: F.when(b.lon - a.lon > 180, -1).when(b.lon - a.lon < -180, 1).otherwise(0))
    jumps = F.filter(F.transform(near, lambda turn, k: F.struct(k.alias("k"), turn.alias("turn"))), lambda j: j.turn != 0)
    turned = F.transform(ring, lambda p, k: F.struct((_whole(p.lon) + F.aggregate(jumps, F.lit(0).cast("long"), lambda n, j: n + F.when(j.k < k, j.turn * TURN).otherwise(0))).alias("x"), _whole(p.lat).alias("y")))
    # The least longitude lies between -180 and 180.
    return F.when(F.size(jumps) == 0, turned).otherwise(F.transform(turned, lambda p: F.struct((p.x - F.floor((F.array_min(F.transform(turned, lambda q: q.x)) + TURN // 2) / TURN) * TURN).cast("long").alias("x"), p.y.alias("y"))))


def ring_edges(polygons: DataFrame) -> DataFrame:
    """id and the edges (x1, y1, x2, y2) of all rings of every polygon."""
    turned = polygons.where(F.size("ring") >= 3).select("id", unrolled(F.col("ring")).alias("r"))
    steps = F.zip_with("r", F.concat(F.slice("r", 2, F.size("r") - 1), F.slice("r", 1, 1)), lambda a, b: F.struct(a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2")))
    rows = turned.select("id", F.inline(steps))
    return rows.where("x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL AND (x1 <> x2 OR y1 <> y2)")


def boxes(edges: DataFrame) -> DataFrame:
    """id, w, s, e, n of every polygon."""
    return edges.groupBy("id").agg(F.min(F.least("x1", "x2")).alias("w"), F.min(F.least("y1", "y2")).alias("s"), F.max(F.greatest("x1", "x2")).alias("e"), F.max(F.greatest("y1", "y2")).alias("n"))


def _width(edges: DataFrame, a: str, b: str) -> int:
    """Median extent of the edges that have one, from a sketch of bounded size."""
    return max(1, int(edges.where(F.col(a) != F.col(b)).agg(F.percentile_approx(F.abs(F.col(a) - F.col(b)), 0.5)).first()[0] or 1))


def _cut_long(edges: DataFrame, wide: int, high: int) -> DataFrame:
    """Edges of more than MOST_CELLS cells in parts of no more, which meet in whole coordinates."""
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x1")) / wide, F.abs(F.col("y2") - F.col("y1")) / high) / MOST_CELLS)).cast("long")
    at = lambda c, k: (F.col(f"{c}1") + F.round((F.col(f"{c}2") - F.col(f"{c}1")) * (k / F.col("parts")))).cast("long")
    rest = [c for c in edges.columns if c not in POINT]
    k = F.col("k")
    parts = edges.withColumn("parts", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return parts.select(*rest, at("x", k).alias("x1"), at("y", k).alias("y1"), at("x", k + 1).alias("x2"), at("y", k + 1).alias("y2"))


def _cells(low: Column, high: Column, width: int) -> Column:
    return F.sequence(F.floor(low / width), F.floor(high / width))


def _meetings(p: str, q: str) -> Column:
    """Where two edges meet: (edge, x, y) rows of corners of one on the other, or of their crossing on both; empty if they don't.

    A corner within half a step of the grid is on an edge.
    """
    c = lambda e, f: F.col(f"{e}.{f}").cast("double")
    dx, dy = {e: c(e, "x2") - c(e, "x1") for e in (p, q)}, {e: c(e, "y2") - c(e, "y1") for e in (p, q)}

    def off(e: str, f: str, k: int) -> tuple[Column, Column, Column]:
        """Side, distance and place along e of corner k of f."""
        x, y = c(f, f"x{k}") - c(e, "x1"), c(f, f"y{k}") - c(e, "y1")
        side, length = dx[e] * y - dy[e] * x, F.sqrt(dx[e] * dx[e] + dy[e] * dy[e])
        return side, F.abs(side) / length, (x * dx[e] + y * dy[e]) / length / length

    corners = [(e, f, k, *off(e, f, k)) for e, f in ((p, q), (q, p)) for k in (1, 2)]
    on = [(distance <= 0.75) & (at >= 0) & (at <= 1) for _, _, _, _, distance, at in corners]
    touched = [F.when(hit, F.struct(F.col(f"{e}.e").alias("e"), F.col(f"{f}.x{k}").alias("x"), F.col(f"{f}.y{k}").alias("y"))) for (e, f, k, *_), hit in zip(corners, on, strict=True)]
    s = [row[3] for row in corners]
    apart = (s[0] * s[1] < 0) & (s[2] * s[3] < 0) & ~reduce(lambda a, b: a | b, on)
    t = s[2] / (s[2] - s[3])
    x, y = F.round(c(p, "x1") + t * dx[p]).cast("long"), F.round(c(p, "y1") + t * dy[p]).cast("long")
    crossed = [F.when(apart, F.struct(F.col(f"{e}.e").alias("e"), x.alias("x"), y.alias("y"))) for e in (p, q)]
    return F.filter(F.array(*touched, *crossed), lambda m: m.isNotNull())


def _pieces(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The edges cut where edges of the same keys meet: keys, side, and from the lower to the upper end (ax, ay, bx, by), with how often each is there."""
    wide, high = _width(edges, "x1", "x2"), _width(edges, "y1", "y2")
    e = cut(_cut_long(edges, wide, high).where("x1 <> x2 OR y1 <> y2").withColumn("e", F.monotonically_increasing_id()))
    low, top = {c: F.least(f"{c}1", f"{c}2") for c in "xy"}, {c: F.greatest(f"{c}1", f"{c}2") for c in "xy"}
    dealt = e.select(*keys, "e", *POINT, *[low[c].alias(f"lo_{c}") for c in "xy"], *[top[c].alias(f"hi_{c}") for c in "xy"])
    dealt = dealt.withColumn("cx", F.explode(_cells(F.col("lo_x") - 1, F.col("hi_x") + 1, wide))).withColumn("cy", F.explode(_cells(F.col("lo_y") - 1, F.col("hi_y") + 1, high)))
    p, q = dealt.alias("p"), dealt.alias("q")
    same = [F.col(f"p.{k}") == F.col(f"q.{k}") for k in (*keys, "cx", "cy")]
    near = [F.col(f"p.lo_{c}") - 1 <= F.col(f"q.hi_{c}") for c in "xy"] + [F.col(f"q.lo_{c}") - 1 <= F.col(f"p.hi_{c}") for c in "xy"]
    # The cell of the low corner of the shared box stands for all cells that two edges share.
    home = [F.floor((F.greatest(F.col(f"p.lo_{c}"), F.col(f"q.lo_{c}")) - 1) / width) == F.col(f"p.c{c}") for c, width in (("x", wide), ("y", high))]
    met = p.join(q, reduce(lambda a, b: a & b, [*same, F.col("p.e") < F.col("q.e"), *near, *home])).select(F.inline(_meetings("p", "q")))
    ends = e.select("e", F.col("x1").alias("x"), F.col("y1").alias("y")).unionByName(e.select("e", F.col("x2").alias("x"), F.col("y2").alias("y")))
    places = met.unionByName(ends).distinct().join(e.select(F.col("e").alias("of"), *keys, "side", *POINT), F.col("e") == F.col("of"))
    along = (F.col("x") - F.col("x1")).cast("double") * (F.col("x2") - F.col("x1")) + (F.col("y") - F.col("y1")).cast("double") * (F.col("y2") - F.col("y1"))
    order = Window.partitionBy("e").orderBy("along", "x", "y")
    steps = places.withColumn("along", along).withColumns({"tox": F.lead("x").over(order), "toy": F.lead("y").over(order)}).where("tox IS NOT NULL")
    up = (F.col("y") < F.col("toy")) | ((F.col("y") == F.col("toy")) & (F.col("x") < F.col("tox")))
    end = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    laid = steps.select(*keys, "side", end("x", "tox").alias("ax"), end("y", "toy").alias("ay"), end("tox", "x").alias("bx"), end("toy", "y").alias("by"))
    return laid.groupBy(*keys, "side", "ax", "ay", "bx", "by").agg(F.count("*").alias("n"))


def arrangement(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Every piece of the edges (keys, side, x1, y1, x2, y2), and for each polygon (side) that is there or west of it, whether it lies left and right of the piece.

    Left is west of a piece that goes up, and above one that goes east. Pieces
    of different keys do not meet.
    """
    pieces = cut(_pieces(edges, keys))
    lines = ["ax", "ay", "bx", "by"]
    high = _width(pieces.where("ay <> by"), "ay", "by")
    # (The middle of a piece, and bands, in doubles: halves of whole numbers are exact.)
    middle = pieces.select(*keys, *lines).distinct().withColumns({"mx": (F.col("ax") + F.col("bx")) / 2, "my": (F.col("ay") + F.col("by")) / 2}).withColumn("band", F.floor(F.col("my") / high))
    walls = pieces.where("ay <> by AND n % 2 = 1").select(*keys, F.col("side"), *[F.col(c).alias(f"w{c}") for c in lines])
    walls = walls.withColumn("band", F.explode(_cells(F.col("way"), F.col("wby"), high)))
    west = F.col("wax") + (F.col("my") - F.col("way")) * ((F.col("wbx") - F.col("wax")) / (F.col("wby") - F.col("way"))) < F.col("mx")
    other = reduce(lambda a, b: a | b, [F.col(c) != F.col(f"w{c}") for c in lines])
    passed = middle.join(walls, [*keys, "band"]).where((F.col("way") <= F.col("my")) & (F.col("my") < F.col("wby")) & west & other)
    seen = passed.select(*keys, *lines, "side", F.lit(1).alias("over"), F.lit(0).cast("long").alias("n")).unionByName(pieces.select(*keys, *lines, "side", F.lit(0).alias("over"), "n"))
    found = seen.groupBy(*keys, *lines, "side").agg(F.sum("over").alias("over"), F.sum("n").alias("n"))
    return found.select(*keys, *lines, "side", (F.col("over") % 2 == 1).alias("left"), ((F.col("over") + F.col("n")) % 2 == 1).alias("right"), (F.col("n") > 0).alias("edge"))


def outlines(arranged: DataFrame, keys: list[str], inside: dict[str, Column]) -> DataFrame:
    """Directed edges (keys, kind, x1, y1, x2, y2), with the result to their left.

    ``inside`` gives for each kind of result whether a place belongs to it, by
    columns a, b (the place lies in polygon 0, 1) and any (in some polygon).
    """
    lines = ["ax", "ay", "bx", "by"]
    in_ = lambda side, k: F.coalesce(F.bool_or(F.when(F.col("side") == k, F.col(side))), F.lit(False))
    told = arranged.groupBy(*keys, *lines).agg(*[x for side in ("left", "right") for x in (in_(side, 0).alias(f"{side}_a"), in_(side, 1).alias(f"{side}_b"), F.bool_or(side).alias(f"{side}_any"))])
    out = None
    for kind, rule in inside.items():
        as_side = lambda side: {f"in_{c}": F.col(f"{side}_{c}") for c in ("a", "b", "any")}
        both = told.withColumns(as_side("left")).withColumn("l", rule).withColumns(as_side("right")).withColumn("r", rule).where("l <> r")
        end = lambda a, b: F.when(F.col("l"), F.col(a)).otherwise(F.col(b))
        rows = both.select(*keys, F.lit(kind).alias("kind"), end("ax", "bx").alias("x1"), end("ay", "by").alias("y1"), end("bx", "ax").alias("x2"), end("by", "ay").alias("y2"))
        out = rows if out is None else out.unionByName(rows)
    return out


def rules() -> dict[str, Column]:
    """Intersection, union and difference of polygons 0 and 1."""
    a, b = F.col("in_a"), F.col("in_b")
    return {"intersection": a & b, "union": a | b, "difference": a & ~b}


def area(unit: float = GRID) -> Column:
    """Aggregate: area in square degrees that directed edges surround."""
    x, y = (F.col("x1") + F.col("x2")).cast("double"), (F.col("y2") - F.col("y1")).cast("double")
    return F.sum(x * y) / 2 * unit * unit


def candidates(left: DataFrame, right: DataFrame, most: int = 100_000) -> DataFrame:
    """Pairs (a, b, turn) of polygons whose boxes meet when b is turned by ``turn`` times 360 degrees; both given as boxes."""
    turned = right.withColumn("turn", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))).withColumns({"w": F.col("w") + F.col("turn") * TURN, "e": F.col("e") + F.col("turn") * TURN})
    return join_boxes(left, turned, most).select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), F.col("r_turn").alias("turn"))


PAIR = ["a", "b", "turn"]


def paired(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Edges of each pair (a, b, turn): side 0 of a, side 1 of b in its turn."""
    turn = F.col("turn") * TURN
    one = pairs.join(left.withColumnRenamed("id", "a"), "a").select(*PAIR, F.lit(0).alias("side"), *POINT)
    two = pairs.join(right.withColumnRenamed("id", "b"), "b").select(*PAIR, F.lit(1).alias("side"), (F.col("x1") + turn).alias("x1"), "y1", (F.col("x2") + turn).alias("x2"), "y2")
    return one.unionByName(two)


def _by_turn(arranged: DataFrame) -> DataFrame:
    """For each pair and turn: is there a place in both, in a alone, in b alone, and a corner that both have?"""
    lines = ["ax", "ay", "bx", "by"]
    in_ = lambda side, k: F.coalesce(F.bool_or(F.when(F.col("side") == k, F.col(side))), F.lit(False))
    told = arranged.groupBy(*PAIR, *lines).agg(*[in_(side, k).alias(f"{side}_{c}") for side in ("left", "right") for k, c in ((0, "a"), (1, "b"))])
    here = lambda a, b: F.bool_or((F.col("left_a") == a) & (F.col("left_b") == b) | (F.col("right_a") == a) & (F.col("right_b") == b))
    by_turn = told.groupBy(*PAIR).agg(here(True, True).alias("both"), here(True, False).alias("only_a"), here(False, True).alias("only_b"))
    corners = arranged.where("edge").select(*PAIR, "side", F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("c"))
    shared = corners.groupBy(*PAIR, "c").agg((F.count_distinct("side") > 1).alias("both_have")).groupBy(*PAIR).agg(F.bool_or("both_have").alias("meet"))
    return by_turn.join(shared, PAIR)


def _told(by_turn: DataFrame) -> DataFrame:
    return by_turn.groupBy("a", "b").agg(
        F.bool_or(F.col("both") | F.col("meet")).alias("intersects"), (F.bool_or("meet") & ~F.bool_or("both")).alias("touches"),
        F.bool_or(~F.col("only_b")).alias("covers"), F.bool_or(~F.col("only_a")).alias("within"), F.bool_or(~F.col("only_a") & ~F.col("only_b")).alias("equals"),
    )


def relations(arranged: DataFrame) -> DataFrame:
    """For each pair (a, b): intersects, touches, covers, within, equals.

    They follow from what lies beside the pieces: a place in both, in a alone,
    in b alone, or a corner or piece that both have. A polygon covers another if
    one turn of 360 degrees holds all of it.
    """
    return _told(_by_turn(arranged))


def _about(edges: DataFrame) -> DataFrame:
    """id, box and a place on the border of what is inside (px, py; null if nothing is) of every polygon."""
    middle = F.struct(((F.col("ay") + F.col("by")) / 2).alias("y"), ((F.col("ax") + F.col("bx")) / 2).alias("x"))
    places = _pieces(edges.withColumn("side", F.lit(0)), ["id"]).where("n % 2 = 1").groupBy("id").agg(F.min(middle).alias("p"))
    return boxes(edges).join(places, "id", "left").select("id", "w", "s", "e", "n", F.col("p.x").alias("px"), F.col("p.y").alias("py"))


def _near(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """For each pair: has_a, has_b (something is inside), near_a, near_b (an edge meets the box that both boxes share), in_a, in_b (the place of the other lies inside)."""
    named = lambda edges, k: _about(edges).select(*[F.col(c).alias(k if c == "id" else f"{k}_{c}") for c in ("id", "w", "s", "e", "n", "px", "py")])
    turn = F.col("turn") * TURN
    placed = pairs.join(named(left, "a"), "a").join(named(right, "b"), "b").withColumns({c: F.col(c) + turn for c in ("b_w", "b_e", "b_px")})
    shared = {"w": F.greatest("a_w", "b_w") - 2, "s": F.greatest("a_s", "b_s") - 2, "e": F.least("a_e", "b_e") + 2, "n": F.least("a_n", "b_n") + 2}
    placed = cut(placed.select(*PAIR, *[x.alias(c) for c, x in shared.items()], *[f"{k}_{c}" for k in "ab" for c in ("px", "py")]))
    d = lambda c: F.col(c).cast("double")
    dx, dy = d("x2") - d("x1"), d("y2") - d("y1")
    side = [dx * (d(y) - d("y1")) - dy * (d(x) - d("x1")) for x in "we" for y in "sn"]
    beside = (F.least(*side) > 0) | (F.greatest(*side) < 0)
    meets = (F.least("x1", "x2") <= F.col("e")) & (F.greatest("x1", "x2") >= F.col("w")) & (F.least("y1", "y2") <= F.col("n")) & (F.greatest("y1", "y2") >= F.col("s")) & ~beside

    def seen(edges: DataFrame, own: str, other: str, turned: Column) -> DataFrame:
        e = edges.select(F.col("id").alias(own), *POINT)
        x, y = F.col(f"{other}_px"), F.col(f"{other}_py")
        west = ((F.col("y1") > y) != (F.col("y2") > y)) & (d("x1") + (y - d("y1")) * (dx / dy) < x)
        rows = placed.join(e, own).withColumns({"x1": F.col("x1") + turned, "x2": F.col("x2") + turned})
        return rows.select(*PAIR, F.lit(own).alias("of"), F.col(f"{own}_px").isNotNull().alias("has"), meets.alias("near"), F.coalesce(west, F.lit(False)).cast("int").alias("west"))

    rows = seen(left, "a", "b", F.lit(0).cast("long")).unionByName(seen(right, "b", "a", turn))
    of = lambda k, c: F.when(F.col("of") == k, F.col(c))
    return rows.groupBy(*PAIR).agg(*[x for k in "ab" for x in (F.bool_or(of(k, "has")).alias(f"has_{k}"), F.bool_or(of(k, "near")).alias(f"near_{k}"), (F.sum(of(k, "west")) % 2 == 1).alias(f"in_{k}"))])


def related(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``relations`` of pairs (a, b, turn) of polygons given as edges; only pairs whose borders may meet are arranged.

    Where no edge of a meets the box that both boxes share, a holds all of that
    box or nothing of it, so one place on the border of b tells, and the other
    way round; a itself has places outside of b then. An edge on the border of
    the box, or next to it, meets it.
    """
    told = cut(_near(pairs, left, right))
    hard = F.col("near_a") & F.col("near_b")
    both = F.col("has_a") & F.col("has_b") & F.when(F.col("near_b"), F.col("in_a")).when(F.col("near_a"), F.col("in_b")).otherwise(False)
    easy = told.where(~hard).withColumn("both", both)
    easy = easy.select(*PAIR, "both", (F.col("has_a") & ~(F.col("near_a") & F.col("both"))).alias("only_a"), (F.col("has_b") & ~(F.col("near_b") & F.col("both"))).alias("only_b"), F.lit(False).alias("meet"))
    return _told(easy.unionByName(_by_turn(arrangement(paired(told.where(hard).select(*PAIR), left, right), PAIR))))


FINEST = 14


def _finer(middle: DataFrame, width: int, most: int = 6) -> int:
    """How often tiles of ``width`` have to be halved so that a polygon shares its tile with ``most`` of its group on average, itself included; FINEST times at most."""
    at = middle.select("group", F.explode(F.sequence(F.lit(0), F.lit(FINEST))).alias("k"), "mx", "my")
    tile = [F.floor(F.col(c) * F.pow(F.lit(2.0), "k") / width).alias(c) for c in ("mx", "my")]
    n = F.col("n").cast("double")
    shares = at.groupBy("group", "k", *tile).agg(F.count("*").alias("n")).groupBy("k").agg((F.sum(n * n) / F.sum(n)).alias("mates")).collect()
    return min((r.k for r in shares if r.mates <= most), default=FINEST if shares else 0)


def dissolved(edges: DataFrame, levels: int = 3, size: float = 45.0) -> DataFrame:
    """Union of all polygons of a group: directed edges (group, x1, y1, x2, y2) around it; given as (group, id, edges).

    A tree: polygons whose middle lies in one tile are united first, then what
    came of sixteen tiles, and so on, so that edges inside of a tile go before
    tiles meet, and no task sees a whole group. The first tiles are parts of
    those of ``size`` that hold a few polygons each, so that what meets in a
    tile does not grow with the number of polygons. Of polygons with the same
    edges, one is taken.
    """
    width = int(size / GRID)
    same = [F.sum(F.xxhash64(*POINT, F.lit(k)).cast("decimal(38,0)")).alias(f"same{k}") for k in (0, 1)]
    about = edges.groupBy("group", "id").agg(((F.min("x1") + F.max("x1")) / 2).alias("mx"), ((F.min("y1") + F.max("y1")) / 2).alias("my"), F.count("*").alias("corners"), *same)
    middle = cut(about.groupBy("group", "mx", "my", "corners", "same0", "same1").agg(F.min("id").alias("id")).select("group", "id", "mx", "my"))
    finer = _finer(middle, width)
    tiles = middle.select("group", "id", *[F.floor(F.col(f"m{c}") * 2**finer / width).alias(f"t{c}") for c in "xy"])
    left = edges.join(tiles, ["group", "id"]).select("group", "tx", "ty", F.xxhash64("id").alias("side"), *POINT)
    keys = ["group", "tx", "ty"]
    rounds = -(-(finer + levels) // 2)
    for level in range(rounds + 1):
        if level == rounds:
            left = left.withColumns({"tx": F.lit(0).cast("long"), "ty": F.lit(0).cast("long")})
        done = cut(outlines(arrangement(left, keys), keys, {"union": F.col("in_any")}).drop("kind"))
        left = done.withColumn("side", F.xxhash64("tx", "ty")).withColumns({"tx": F.floor(F.col("tx") / 4), "ty": F.floor(F.col("ty") / 4)})
    return done.drop("tx", "ty")


def repaired(edges: DataFrame) -> DataFrame:
    """Directed edges (id, ..) around the inside of each polygon by the even-odd rule, cut where they cross."""
    return outlines(arrangement(edges.withColumn("side", F.lit(0)), ["id"]), ["id"], {"valid": F.col("in_any")}).drop("kind")


def _link(g: pd.DataFrame) -> list[list[tuple[int, int]]]:
    """Rings of directed edges; where several go on, the one that turns left most, so that rings touch but do not cross."""
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x1, y1, x2, y2 in sorted(zip(g.x1.tolist(), g.y1.tolist(), g.x2.tolist(), g.y2.tolist(), strict=True)):
        out.setdefault((x1, y1), []).append((x2, y2))
    rings = []
    for start in list(out):
        while out[start]:
            ring, at = [start], out[start].pop()
            while at != start:
                last = ring[-1]
                back = math.atan2(last[1] - at[1], last[0] - at[0])
                ways = out.get(at)
                if not ways:
                    raise ValueError("the edges do not close")
                ring.append(at)
                # Clockwise from where one came, the first way is the sharpest to the left.
                k = min(range(len(ways)), key=lambda i: (back - math.atan2(ways[i][1] - at[1], ways[i][0] - at[0])) % (2 * math.pi) or 2 * math.pi)
                at = ways.pop(k)
            rings.append(ring)
    return rings


def rings(outline: DataFrame, keys: list[str]) -> DataFrame:
    """keys, part, ring (array of (lat, lon)) of directed edges; counter-clockwise around parts, clockwise around holes."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in outline.schema if f.name in keys) + ", part int, ring array<struct<lat: double, lon: double>>"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        found = _link(g)
        own = {k: [g[k].iloc[0]] * len(found) for k in keys}
        return pd.DataFrame(own | {"part": range(len(found)), "ring": [[{"lat": y * GRID, "lon": x * GRID} for x, y in r] for r in found]})

    return outline.groupBy(*keys).applyInPandas(run, schema)
