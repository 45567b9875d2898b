"""Points of low discrepancy attached to the rows of a table, in columns: Latin hypercubes and Sobol points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from . import stats

BITS = 30
# Of each dimension after the first, degree and coefficients of a primitive polynomial over GF(2), and its first direction numbers.
SOBOL = [(1, 0, (1,)), (2, 1, (1, 3)), (3, 1, (1, 3, 1)), (3, 2, (1, 1, 1)), (4, 1, (1, 1, 3, 3)), (4, 4, (1, 3, 5, 13)), (5, 2, (1, 1, 5, 5, 17))]


def directions(dimension: int) -> list[int]:
    """BITS direction numbers, the first that of the highest bit, of a dimension from 0 to 7."""
    if dimension == 0:
        return [1 << (BITS - 1 - k) for k in range(BITS)]
    degree, inner, m = SOBOL[dimension - 1]
    odd = list(m)
    for k in range(degree, BITS):
        new = odd[k - degree] ^ (odd[k - degree] << degree)
        for j in range(1, degree):
            if inner >> (degree - 1 - j) & 1:
                new ^= odd[k - j] << j
        odd.append(new)
    return [x << (BITS - 1 - k) for k, x in enumerate(odd)]


def sobol(index: Column, dimension: int) -> Column:
    """Coordinate, in [0, 1), of the point of an index from 0 to 2**30 - 1 in Gray code order; null outside."""
    i = index.cast("long")
    gray = i.bitwiseXOR(F.shiftright(i, 1))
    parts = [F.when(F.shiftright(gray, k).bitwiseAND(F.lit(1)) == 1, F.lit(v)).otherwise(F.lit(0)) for k, v in enumerate(directions(dimension))]
    return F.when((i >= 0) & (i < 1 << BITS), reduce(lambda a, b: a.bitwiseXOR(b), parts) / float(1 << BITS))


def latin_hypercube(df: DataFrame, key: str, axes: list[str]) -> DataFrame:
    """``df`` with a column an axis: one row in each of as many equal cells as rows, by a hash of the key, which is unique.

    Cells are ranks of hashes, dealt by range, so no task sorts the table.
    """
    out = df
    for axis in axes:
        order = df.select(F.lit(0).alias("_all"), F.struct(sc.hash_number("order", axis, F.col(key)).alias("h"), F.col(key).alias("k")).alias("o"))
        places = stats.counted(order.withColumnRenamed("_all", "_one"), ["_one"], "o").select(F.col("o.k").alias(key), ((F.col("_before") + sc.uniform("jitter", axis, F.col("o.k"))) / F.col("_all")).alias(axis))
        out = out.join(places, key)
    return out
