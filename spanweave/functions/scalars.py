"""Scalar rules as columns: guards, rounding modes, timestamps, Allen inverses, unit expressions, portable random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDINGS = ("up", "down", "ceiling", "floor", "half_up", "half_down", "half_even", "05up")
# The inverse of each of Allen's relations.
INVERSES = {
    "before": "after", "after": "before", "meets": "met_by", "met_by": "meets", "overlaps": "overlapped_by", "overlapped_by": "overlaps", "starts": "started_by", "started_by": "starts",
    "during": "contains", "contains": "during", "finishes": "finished_by", "finished_by": "finishes", "equals": "equals",
}
# Factor to SI, and exponents of length, mass, time, current, temperature and information.
UNITS = {
    "1": (1.0, (0, 0, 0, 0, 0, 0)), "m": (1.0, (1, 0, 0, 0, 0, 0)), "km": (1000.0, (1, 0, 0, 0, 0, 0)), "kg": (1.0, (0, 1, 0, 0, 0, 0)), "t": (1000.0, (0, 1, 0, 0, 0, 0)),
    "s": (1.0, (0, 0, 1, 0, 0, 0)), "h": (3600.0, (0, 0, 1, 0, 0, 0)), "A": (1.0, (0, 0, 0, 1, 0, 0)), "K": (1.0, (0, 0, 0, 0, 1, 0)), "N": (1.0, (1, 1, -2, 0, 0, 0)),
    "W": (1.0, (2, 1, -3, 0, 0, 0)), "kW": (1e3, (2, 1, -3, 0, 0, 0)), "MW": (1e6, (2, 1, -3, 0, 0, 0)), "kWh": (3.6e6, (2, 1, -2, 0, 0, 0)), "bit": (1.0, (0, 0, 0, 0, 0, 1)), "B": (8.0, (0, 0, 0, 0, 0, 1)),
}


def guard_holds(current: Column, op: Column, target: Column) -> Column:
    """A comparison by name (eq, ne, lt, le, ge, gt); null equals null alone and holds in no order; other names are an error."""
    order = F.when(op == "lt", current < target).when(op == "le", current <= target).when(op == "ge", current >= target).when(op == "gt", current > target)
    known = order.otherwise(F.raise_error(F.concat(F.lit("no such comparison: "), op)).cast("boolean"))
    return F.when(op == "eq", current.eqNullSafe(target)).when(op == "ne", ~current.eqNullSafe(target)).otherwise(F.coalesce(known, F.lit(False)))


def quantize(x: Column, digits: int, mode: str) -> Column:
    """A decimal at so many digits by one of eight rounding modes; 05up goes away from zero where the last digit is 0 or 5."""
    y = (x * F.lit(10**digits)).cast("decimal(36,8)")
    size, sign = F.abs(y), F.when(y < 0, -1).otherwise(1)
    low = F.floor(size)
    rest = size - low
    more = {
        "down": F.lit(False), "up": rest > 0, "floor": (rest > 0) & (y < 0), "ceiling": (rest > 0) & (y > 0), "half_up": rest >= 0.5, "half_down": rest > 0.5,
        "half_even": (rest > 0.5) | ((rest == 0.5) & (low % 2 == 1)), "05up": (rest > 0) & (low % 5 == 0),
    }[mode]
    return (sign * (low + more.cast("int")) / F.lit(10**digits)).cast(f"decimal(28,{digits})")


def parse_rfc3339(text: Column) -> Column:
    """The instant in UTC, without a zone, of a full date-time with Z or an offset of hours and minutes; null if malformed.

    Digits beyond microseconds are cut off. White space around the text is left out.
    """
    t = F.trim(text)
    shape = t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$")
    base = F.concat(F.substring(t, 1, 10), F.lit(" "), F.substring(t, 12, 8)).try_cast("timestamp_ntz")
    micros = F.rpad(F.substring(F.regexp_extract(t, r"\.([0-9]+)", 1), 1, 6), 6, "0")
    part = lambda k: F.coalesce(F.regexp_extract(t, r"([+-])([0-9]{2}):([0-9]{2})$", k).try_cast("int"), F.lit(0))
    minutes = F.when(t.rlike(r"-[0-9]{2}:[0-9]{2}$"), -1).otherwise(1) * (part(2) * 60 + part(3))
    shift = F.make_dt_interval(mins=-minutes, secs=F.coalesce(micros.try_cast("decimal(18,6)"), F.lit(0)) / 1000000)
    return F.when(shape & (part(2) <= 23) & (part(3) <= 59), base + shift)


def to_rfc3339(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def allen_inverse(relation: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in INVERSES.items() for x in pair])[relation]


def parse_units(expression: Column) -> Column:
    """Struct (scale, dimension) of a product such as kg*m/s^2, without parentheses; null if a part is unknown."""
    term = r"^([A-Za-z]+|1)(\^(-?[0-9]{1,4}))?$"
    text = F.regexp_replace(expression, " ", "")
    parts = F.split(F.regexp_replace(text, r"([*/])", " $1"), " ")
    rows = F.create_map(*[x for code, (scale, dims) in UNITS.items() for x in (F.lit(code), F.struct(F.lit(scale).alias("scale"), F.array(*map(F.lit, dims)).alias("dims")))])

    def read(part: Column) -> Column:
        body = F.regexp_replace(part, r"^[*/]", "")
        power = F.coalesce(F.regexp_extract(body, term, 3).try_cast("int"), F.lit(1)) * F.when(part.startswith("/"), -1).otherwise(1)
        unit = F.try_element_at(rows, F.regexp_extract(body, term, 1))
        return F.struct(F.pow(unit.scale, power).alias("scale"), F.transform(unit.dims, lambda x: x * power).alias("dims"))

    start = F.struct(F.lit(1.0).alias("scale"), F.array(*[F.lit(0)] * 6).alias("dims"))
    folded = F.aggregate(F.transform(parts, read), start, lambda a, p: F.struct((a.scale * p.scale).alias("scale"), F.zip_with(a.dims, p.dims, lambda x, y: x + y).alias("dims")))
    return F.when(folded.scale.isNotNull(), F.struct(folded.scale.alias("scale"), F.array_join(folded.dims.cast("array<string>"), ",").alias("dimension")))


def hash_number(*parts: Column | str) -> Column:
    """48 bits of a SHA-256, as a long: the same in every engine."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256), 1, 12), 16, 10).cast("long")


def uniform(*parts: Column | str) -> Column:
    """Deterministic number in [0, 1) of a seed and keys."""
    return hash_number(*parts) / F.lit(float(1 << 48))


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks, joined by commas; a rule that comes out null counts as broken."""
    return F.concat_ws(",", *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
