"""Canonical JSON: one text for each JSON value (RFC 8785), digests and ids on it.

Objects are ordered by the UTF-16 units of their keys, numbers written with
the fewest digits that read back as the same double, strings with the needed
escapes alone. Text that is no JSON, holds a key twice, a lone surrogate or a
number past a double gives null, as null does.
"""

from __future__ import annotations

import json
from decimal import Decimal
from math import isfinite

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x: float) -> str:
    """A double as ECMAScript writes it."""
    if not isfinite(x):
        raise ValueError("not finite")
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    text, point = "".join(map(str, digits)), len(digits) + exponent
    if 0 < point <= 21:
        out = text.ljust(point, "0") if len(text) <= point else f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        out = f"0.{'0' * -point}{text}"
    else:
        out = f"{text[0]}{'.' if len(text) > 1 else ''}{text[1:]}e{point - 1:+d}"
    return "-" + out if sign else out


def _pairs(items: list[tuple[str, object]]) -> dict:
    out = dict(items)
    if len(out) < len(items):
        raise ValueError("a key stands twice")
    return out


def text_of(value: object) -> str:
    """The canonical text of a value of dicts, lists, strings, numbers, booleans and None."""
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, (int, float)):
        return number(float(value))
    if isinstance(value, str):
        value.encode("utf-8")
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, dict):
        return "{" + ",".join(f"{text_of(k)}:{text_of(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    return "[" + ",".join(map(text_of, value)) + "]"


def canonical_text(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return text_of(json.loads(text, object_pairs_hook=_pairs))
    except (ValueError, OverflowError, RecursionError):
        return None


def canonical(text: Column) -> Column:
    """Canonical form of a column of JSON texts."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(canonical_text)

    return run(text)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def identity(kind: str, parts: Column, length: int = 32) -> Column:
    """kind:digest of the kind and an array of parts."""
    preimage = F.to_json(F.struct(F.lit(kind).alias("kind"), parts.alias("parts")))
    return F.concat(F.lit(f"{kind}:"), F.substring(digest(preimage), 1, length))
