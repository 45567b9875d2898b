"""The queries of this subpackage: each operator's own, and parts of some that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, digests, filters, licenses, lm, media, mixing, neardup, pages, phrases, quality, substrings, urls
from .shared import table


def sql_op3_rules(spark, sf_dir):
    """Operator 3 where a rule decides, and host and path everywhere."""
    said = F.when(F.col("rule").isNotNull(), F.col("verdict"))
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", said.alias("verdict"))


def sql_op5_counts(spark, sf_dir):
    """Operator 5's token counts."""
    return lm.score(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def sql_op6_targets(spark, sf_dir):
    """Operator 6's sizes and targets."""
    return mixing.op6_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def sql_op10_bytes(spark, sf_dir):
    """Operator 10's payload, as read back from the stored form."""
    return media.op10_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


OPERATORS = {"op1_substrings": substrings.op1_substrings, "op2_decontaminate": decontaminate.op2_decontaminate, "op3_urls": urls.op3_urls, "op4_neardup": neardup.op4_neardup, "op5_lm": lm.op5_lm, "op6_mixing": mixing.op6_mixing, "op7_quality": quality.op7_quality, "op8_licenses": licenses.op8_licenses, "op9_pages": pages.op9_pages, "op10_media": media.op10_media, "op11_digests": digests.op11_digests, "op12_filters": filters.op12_filters, "op13_phrases": phrases.op13_phrases}

WORDS = "len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))"

PARTS = {
    "sql_op11_edits": (digests.sql_op11_edits, digests.EDITS_SQL),
    "sql_op3_rules": (sql_op3_rules, """
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
rules(rule, said) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
fits AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(said, length(rule)) AS said FROM parts JOIN rules ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY page_id)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, said AS verdict FROM parts LEFT JOIN fits USING (page_id)
"""),
    "sql_op5_counts": (sql_op5_counts, f"SELECT doc_id, {WORDS} + 1 AS n_tokens FROM documents"),
    "sql_op6_targets": (sql_op6_targets, f"""
WITH sized AS (SELECT doc_id, source, {WORDS} AS size FROM documents),
per AS (SELECT source, sum(size)::DOUBLE AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM sized GROUP BY source),
levels AS (SELECT *, 2 * source_size / weight AS full_at FROM per),
level AS (SELECT arg_min(l, full_at) AS level FROM (SELECT a.full_at, (1.5 * (SELECT sum(source_size) FROM per) - coalesce((SELECT sum(2 * b.source_size) FROM levels b WHERE b.full_at < a.full_at), 0)) / (SELECT sum(b.weight) FROM levels b WHERE b.full_at >= a.full_at) AS l FROM levels a) WHERE l < full_at)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, round(least(2 * source_size, coalesce((SELECT level FROM level) * weight, 2 * source_size)), 3) AS target FROM sized JOIN levels ON sized.source IS NOT DISTINCT FROM levels.source
"""),
    "sql_op10_bytes": (sql_op10_bytes, """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents), p AS (SELECT doc_id, x, octet_length(x) AS n, greatest(64, (octet_length(x) + 63) // 64 * 64) AS m FROM b)
SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(x || repeat('\\x00'::BLOB, m - n)) AS payload_sha256 FROM p
"""),
}


def queries() -> dict:
    return OPERATORS | {name: query for name, (query, _) in PARTS.items()}


def oracle_sql() -> dict[str, str]:
    return {"op4_neardup": neardup.ORACLE_SQL, "op12_filters": filters.ORACLE_SQL, "op13_phrases": phrases.ORACLE_SQL} | {name: sql for name, (_, sql) in PARTS.items()}
