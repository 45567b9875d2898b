"""Content addressing, integrity, policy, provenance and text scans."""

from __future__ import annotations

import json
import unicodedata
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

# Shapes of credentials.
SECRETS = (("aws_key", r"AKIA[0-9A-Z]{16}"), ("github_token", r"gh[pousr]_[A-Za-z0-9]{36}"), ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), ("assignment", r"(?i)(?:api[_-]?key|secret|token|password)\s*[:=]\s*['\"]?[A-Za-z0-9_\-]{8,}"))


def content_address(text: str = "text") -> Column:
    return F.sha2(F.col(text), 256)


def once_each(df: DataFrame, key: str, digest: str) -> DataFrame:
    """Per digest: the least key, and how many rows hold it."""
    return df.groupBy(digest).agg(F.min(key).alias(key), F.count("*").alias("copies"))


def flat_id(kind: str, *parts: Column, length: int = 32) -> Column:
    """kind:sha256 prefix of the canonical JSON {"kind", "parts"}; parts are texts without characters that JSON escapes."""
    quoted = F.concat_ws(",", *[F.concat(F.lit('"'), p, F.lit('"')) for p in parts])
    return F.concat(F.lit(f"{kind}:"), F.substring(F.sha2(F.concat(F.lit(f'{{"kind":"{kind}","parts":['), quoted, F.lit("]}")), 256), 1, length))


def canonical_json(value) -> str:
    """JSON with sorted keys, no spaces and no escapes beyond the needed ones."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


NFKC_BYTES = 1 << 20


def nfkc():
    """Texts in NFKC, folded, white space as single spaces. A batch goes in runs of about NFKC_BYTES, so that Python holds no more of its texts at once."""
    @F.arrow_udf("string")
    def run(text: pa.Array) -> pa.Array:
        text = text.cast(pa.large_string())
        ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
        bounds = np.unique([0, *np.searchsorted(ends, np.arange(NFKC_BYTES, ends[-1] if len(ends) else 0, NFKC_BYTES), "right"), len(text)])
        parts = [pa.array([None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()).casefold() for x in text[a:b].to_pylist()], pa.string()) for a, b in pairwise(bounds.tolist())]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return run


def chain_breaks(rows: DataFrame, key: str, order: str, digest: str, previous: str) -> DataFrame:
    """Rows whose stated previous digest is not that of the row before."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.lag(digest).over(w)
    return rows.withColumn("_b", before).where(~F.col(previous).eqNullSafe(F.col("_b"))).drop("_b")


def ancestors(parents: DataFrame) -> DataFrame:
    """node, ancestor: all that stands above, from rows (node, parent); steps are doubled until nothing is new."""
    far = cut(parents.where("parent is not null").select("node", F.col("parent").alias("ancestor")).distinct())
    every = far  # up to as many steps as ``far`` has exactly
    while True:
        up = far.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"))
        grown = every.join(up, "ancestor").select("node", F.col("next").alias("ancestor")).distinct()
        new = cut(grown.join(every, ["node", "ancestor"], "left_anti"))
        if new.isEmpty():
            return every
        far = cut(far.join(up, "ancestor").select("node", F.col("next").alias("ancestor")).distinct())
        every = cut(every.unionByName(new))


def secret_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 1), rule, redacted line, for each line that shows a credential."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rule = F.lit(None).cast("string")
    for name, shape in reversed(SECRETS):
        rule = F.when(F.col("line").rlike(shape), name).otherwise(rule)
    redacted = F.col("line")
    for _, shape in SECRETS:
        redacted = F.regexp_replace(redacted, shape, "[redacted]")
    return lines.select("doc_id", (F.col("pos") + 1).alias("line"), rule.alias("rule"), redacted.alias("text")).where("rule is not null")


def by_entity(rows: DataFrame, about: dict[str, str], entity_id: str) -> DataFrame:
    """Rows about one entity ("kind:key"); ``about`` says which column holds the keys of a kind, so that the filter reaches the scan."""
    kind, _, key = entity_id.partition(":")
    if kind not in about:
        return rows.where(F.lit(False))
    return rows.where(F.col(about[kind]) == F.lit(key).try_cast(rows.schema[about[kind]].dataType))


# Fixed value: the names that a credential is assigned to.
CREDENTIAL = r"(?i)\b(api[_-]?key|token|password|secret)\b\s*[:=].*$"


def credential_lines(docs: DataFrame, most: int = 240) -> DataFrame:
    """doc_id, line (from 1), redacted, digest (of the text) of lines that assign a credential.

    The redacted line is its first ``most`` characters with what follows the
    name left out. Null texts have no lines.
    """
    lines = docs.select("doc_id", F.sha2("text", 256).alias("digest"), F.posexplode(F.split("text", "\n")).alias("pos", "t")).where(F.col("t").rlike(CREDENTIAL))
    return lines.select("doc_id", (F.col("pos") + 1).cast("long").alias("line"), F.regexp_replace(F.substring("t", 1, most), CREDENTIAL, "$1=<redacted>").alias("redacted"), "digest")


def policy(confidence: Column, has_evidence: Column) -> Column:
    return F.when(~has_evidence, "deny").when(confidence < 0.5, "review").otherwise("allow")
