"""Session helpers: lineage cuts in the shared folder, tables by path, byte columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoints(spark: SparkSession) -> str:
    """The context's checkpoint folder.

    It is set here only where neither the session nor the context has one. A
    folder of this machine serves tests with a local master; on a cluster,
    executors would write to disks of their own, so there it is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path beside the checkpoints, which all executors share."""
    return f"{_checkpoints(spark)}/{name}-{uuid.uuid4().hex}"


def _sized(df: DataFrame) -> DataFrame:
    """A checkpointed ``df``, with Spark's default estimate of its size in place of one of more than 63 bits."""
    spark, plan = df.sparkSession, df._jdf.queryExecution().analyzed()
    try:
        if plan.stats().sizeInBytes().bit_length() <= 63:
            return df
    except ValueError:  # too many digits for Python to read
        pass
    jvm, session = spark._jvm, spark._jsparkSession
    none = jvm.scala.Option.empty()
    forgotten = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), session, none, none)
    return type(df)(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, forgotten), spark)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleanup(spark: SparkSession) -> Iterator[None]:
    """Plans that are made meanwhile give up their shuffle files when they have run."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the folder that spark.checkpoint.dir names.

    The shuffle files of its plan go when it is written (a setting of Spark
    that the plan takes up when it is made, hence the select), so that only the
    checkpoint stays on disk.

    A checkpoint keeps Spark's estimate of its size, which joins multiply: over
    rounds of joins and cuts the estimate's digits would grow exponentially, in
    the driver's memory. One of more than 63 bits is forgotten.
    """
    _checkpoints(df.sparkSession)
    with _cleanup(df.sparkSession):
        return _sized(df.select("*").checkpoint(eager=True))


def raw(column: str) -> Column:
    """A string column as its UTF-8 bytes, null as no bytes."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(bytearray()))


def unit(*parts: Column) -> Column:
    """A uniform number in (0, 1) that depends on the parts alone."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 12)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def keyed(column: str) -> Column:
    """An id as text; nulls get a text of their own."""
    return F.coalesce(F.col(column).cast("string"), F.lit("\x00null"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: lineage ends there, sizes are true, and the plan's shuffle files go."""
    path = shared_folder(df.sparkSession, name)
    with _cleanup(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` gave, once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(df.inputFiles()[0])).getParent()
    folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
