"""Cells of the sphere: six faces of a cube, halved thirty times, numbered along Hilbert curves, in integer columns.

A cell's number is its face, its place on the face's curve and a bit that
tells its level, in 64 bits; cells of a face nest as ranges of numbers, so
points join cells of any level by equality of parents or by ranges. Numbers
and tokens are those of the public S2 scheme, with its quadratic projection.

A null or NaN coordinate has a null cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAF = 30
# By orientation (1 swapped, 2 inverted, 3 both), the places of the four quarters 2 i + j on the curve; and how each place turns the quarter's own curve.
PLACES = ((0, 1, 3, 2), (0, 3, 1, 2), (2, 3, 1, 0), (2, 1, 3, 0))
TURNS = (1, 0, 0, 3)


def face_of(lat: Column, lon: Column) -> Column:
    """Struct face, i, j: whole coordinates, 0 to 2**30 - 1, on a face."""
    p, q = F.radians(lat), F.radians(lon)
    xyz = (F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p))
    size = [F.abs(c) for c in xyz]
    axis = F.when((size[0] > size[1]) & (size[0] > size[2]), 0).when((size[0] <= size[1]) & (size[1] > size[2]), 1).otherwise(2)
    pick = lambda k: F.when(axis == 0, xyz[k[0]]).when(axis == 1, xyz[k[1]]).otherwise(xyz[k[2]])
    face = axis + F.when(pick((0, 1, 2)) < 0, 3).otherwise(0)
    x, y, z = xyz
    u = F.when(face == 0, y / x).when(face == 1, -x / y).when(face == 2, -x / z).when(face == 3, z / x).when(face == 4, z / y).otherwise(-y / z)
    v = F.when(face == 0, z / x).when(face == 1, z / y).when(face == 2, -y / z).when(face == 3, y / x).when(face == 4, -x / y).otherwise(-x / z)
    along = lambda w: F.when(w >= 0, 0.5 * F.sqrt(1 + 3 * w)).otherwise(1 - 0.5 * F.sqrt(1 - 3 * w))
    whole = lambda w: F.greatest(F.lit(0), F.least(F.lit((1 << LEAF) - 1), F.floor(along(w) * (1 << LEAF)))).cast("long")
    return F.struct(face.cast("long").alias("face"), whole(u).alias("i"), whole(v).alias("j"))


def _of_table(table: tuple[tuple[int, ...], ...] | tuple[int, ...], *keys: Column) -> Column:
    flat = F.array(*[F.lit(x) for row in table for x in (row if isinstance(row, tuple) else (row,))])
    at = keys[0] * 4 + keys[1] if len(keys) > 1 else keys[0]
    return F.element_at(flat, (at + 1).cast("int"))


def number_of(place: Column) -> Column:
    """Number of the smallest cell of a struct (face, i, j): one step of the curve a level."""
    start = F.struct(F.lit(0).cast("long").alias("pos"), place.face.bitwiseAND(F.lit(1)).cast("int").alias("turned"))

    def step(s: Column, k: Column) -> Column:
        bit = lambda c: F.call_function("shiftright", c, k).bitwiseAND(F.lit(1)).cast("int")
        quarter = _of_table(PLACES, s.turned, bit(place.i) * 2 + bit(place.j))
        return F.struct((s.pos * 4 + quarter).alias("pos"), s.turned.bitwiseXOR(_of_table(TURNS, quarter)).alias("turned"))

    pos = F.aggregate(F.sequence(F.lit(LEAF - 1), F.lit(0)), start, step).pos
    return F.shiftleft(place.face, 61).bitwiseOR(pos * 2 + 1)


def cells(points: DataFrame, name: str = "cell", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``points`` with the number of the smallest cell of each."""
    good = F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    placed = points.withColumn("_place", F.when(good, face_of(F.col(lat), F.col(lon))))
    return placed.withColumn(name, F.when(F.col("_place").isNotNull(), number_of(F.col("_place")))).drop("_place")


def parent(cell: Column, level: int) -> Column:
    """The cell of a level, 0 to 30, that holds a smaller cell."""
    low = 1 << (2 * (LEAF - level))
    return cell.bitwiseAND(F.lit(-low)).bitwiseOR(F.lit(low))


def span(cell: Column) -> tuple[Column, Column]:
    """Least and greatest number of the smallest cells within a cell."""
    low = cell.bitwiseAND(-cell)
    return cell - (low - 1), cell + (low - 1)


def token(cell: Column) -> Column:
    """Sixteen hexadecimal digits without the zeros at the end."""
    return F.regexp_replace(F.lower(F.lpad(F.hex(cell), 16, "0")), "0+$", "")
