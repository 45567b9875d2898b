import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of (doc_id, text) or (doc_id, text, source) rows."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def clashing():
    """Adds columns whose names operators use inside, and renames nothing."""
    from pyspark.sql import functions as F

    def add(df):
        return df.withColumns({c: F.lit("x") for c in ("id", "block", "bytes", "key", "kind", "bucket", "size", "label", "value", "host", "score", "k", "kept", "same")})

    return add
