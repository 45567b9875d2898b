"""A training corpus from raw documents: STAGES in order, each written and read again.

Each stage takes all that its predecessor kept. All but the last return the
columns of documents; the last returns the mix (doc_id, size, source_size,
target, taken, copies).

In every stage a null in any column is let be; an empty table gives an empty
one; further columns are kept (but for the last stage) and may have any name.
What stages do with null and empty texts, repeated rows and ties is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanweave.llm import decontaminate, mixing, neardup, quality, substrings
from spanweave.llm.shared import shared_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression on ``labels`` selects.

    Rows of equal texts are judged alike; a null text is judged as an empty one;
    without labels all stay. A very long text is scored whole, by one task.
    """
    return quality.select(docs, table(spark, sf_dir, "labels"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (five-word shingles, similarity 0.8 and more).

    That is one row: of least doc_id (nulls last) and, if this id has several
    texts in the class, of least hash of the text; of rows that are equal in
    both, one. Rows without words are in no class and all stay.
    """
    return neardup.select(docs, width=5, percent=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes and more that occur again.

    No occurrence of such a string stays, as in operator 1: a passage that
    several documents hold is boilerplate or a quotation, and whole copies have
    gone in the stage before. A text that loses everything goes as a row; null,
    empty and shorter texts stay as they are.
    """
    return substrings.clean(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of ``benchmark``.

    Null and empty texts, and null and empty items, match nothing; equal rows
    are judged alike.
    """
    return decontaminate.select(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document, for sources in the weights 3, 1, 2.

    A null source is a source, ranked last; null and empty texts have size 0
    and are not taken; equal rows are documents of their own.
    """
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", near_stage),
    ("suffix-array dedup", substring_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing to target weights", mixing_stage),
]

# No stage but the last could be put in SQL: tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; what each keeps is written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = shared_folder(spark, "pipeline")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
