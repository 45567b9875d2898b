"""Reading and writing: Parquet and SQL over it, graphs with a digest, key-value and fixed-column headers, text outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sql_over(spark: SparkSession, path: str, query: str, **values) -> DataFrame:
    """SQL over the Parquet data at a path, which it names ``source``; values are bound, not pasted."""
    return spark.sql(query.replace(" source", " {source}"), args=values, source=spark.read.parquet(path))


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> str:
    """Writes both tables as compressed JSON with a manifest; returns the digest."""
    told = digest(vertices, edges)
    vertices.write.mode("overwrite").json(f"{path}/vertices", compression="gzip")
    edges.write.mode("overwrite").json(f"{path}/edges", compression="gzip")
    vertices.sparkSession.createDataFrame([(told,)], "digest string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return told


def read_graph(spark: SparkSession, path: str, vertex_schema, edge_schema) -> tuple[DataFrame, DataFrame]:
    """Reads what ``write_graph`` wrote; an error if the digest does not fit."""
    vertices, edges = spark.read.schema(vertex_schema).json(f"{path}/vertices"), spark.read.schema(edge_schema).json(f"{path}/edges")
    if digest(vertices, edges) != spark.read.json(f"{path}/manifest").first().digest:
        raise ValueError("the graph differs from its digest")
    return vertices, edges


def digest(vertices: DataFrame, edges: DataFrame) -> str:
    """A digest of two tables that does not depend on the order of rows.

    Rows are hashed, and their hashes (as four 64-bit sums, modulo 2**64 each)
    added up, so no table is gathered anywhere.
    """
    def sums(df: DataFrame) -> list[str]:
        h = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
        parts = [F.sum(F.conv(F.substring(h, 1 + 16 * k, 16), 16, 10).cast("decimal(38,0)")) for k in range(4)]
        row = df.agg(F.count("*"), *parts).first()
        return [str(row[0]), *(f"{int(x or 0) % (1 << 64):016x}" for x in row[1:])]

    return ":".join([*sums(vertices), *sums(edges)])


def key_values(texts: DataFrame, required: list[str]) -> DataFrame:
    """Columns from "KEY = value" lines; texts that lack a required key give no row."""
    pairs = F.transform(F.filter(F.split("text", "\n"), lambda x: x.contains("=")), lambda x: F.struct(F.trim(F.split(x, "=", 2)[0]).alias("k"), F.trim(F.split(x, "=", 2)[1]).alias("v")))
    found = texts.select(F.map_from_entries(pairs).alias("m"))
    whole = F.lit(True)
    for k in required:
        whole = whole & F.map_contains_key("m", k)
    return found.where(whole).select(*[F.col("m")[k].alias(k.lower()) for k in required])


def rinex_header(texts: DataFrame) -> DataFrame:
    """version, kind and system from the first header line (fixed columns)."""
    line = F.element_at(F.filter(F.split("text", "\n"), lambda x: x.contains("RINEX VERSION / TYPE")), 1)
    return texts.select(F.trim(F.substring(line, 1, 9)).cast("double").alias("version"), F.substring(line, 21, 1).alias("kind"), F.substring(line, 41, 1).alias("system"))


def merge_rows(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert: new rows replace those of equal key."""
    return current.join(new.select(key), key, "left_anti").unionByName(new)


def as_markdown(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |")).alias("line"))


def write_rows(rows: DataFrame, path: str) -> None:
    """Rows as Parquet, in place of what lies there; Spark commits the files of a job together."""
    rows.write.mode("overwrite").parquet(path)


def save_snapshot(rows: DataFrame, path: str, snapshot_id: str) -> None:
    """Rows as one snapshot of a store of snapshots; a snapshot saved again is replaced as a whole."""
    rows.write.mode("overwrite").parquet(f"{path}/snapshot_id={snapshot_id}")


def load_snapshot(spark: SparkSession, path: str, snapshot_id: str) -> DataFrame:
    return spark.read.parquet(f"{path}/snapshot_id={snapshot_id}")


def arrow_tables(vertices: DataFrame, edges: DataFrame, most: int = 1_000_000) -> dict:
    """A graph as two Arrow tables on the driver; an error if either has over ``most`` rows."""
    out = {}
    for name, df in (("vertices", vertices), ("relationships", edges)):
        table = df.limit(most + 1).toArrow()
        if table.num_rows > most:
            raise ValueError(f"{name} are too many for one Arrow table")
        out[name] = table
    return out


def write_json(rows: DataFrame, path: str) -> None:
    """Rows as lines of JSON, nulls included."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def put_objects(contents: DataFrame, path: str) -> None:
    """Contents (digest, content) as objects of a store, each digest once, in shards by its first digit."""
    contents.dropDuplicates(["digest"]).withColumn("shard", F.substring("digest", 1, 1)).write.mode("overwrite").partitionBy("shard").parquet(path)


def verify_objects(spark: SparkSession, path: str) -> DataFrame:
    """digest, intact: whether the SHA-256 of each stored content is its digest; false for null content."""
    rows = spark.read.schema("digest string, content string, shard string").parquet(path)
    return rows.select("digest", F.coalesce(F.sha2("content", 256) == F.col("digest"), F.lit(False)).alias("intact"))
