"""What is cut or written keeps no shuffle files behind."""

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spanweave.llm import shared
from spanweave.plans import lineage


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for folder in folders for _, _, files in os.walk(folder.getPath()) for f in files if f.startswith("shuffle_") and f.endswith(".data")}


KEEPERS = {"shared.written": lambda df: shared.written(df, "some"), "shared.cut": shared.cut, "lineage.written": lambda df: lineage.written(df, "some"), "lineage.cut": lineage.cut}


@pytest.mark.parametrize("how", list(KEEPERS))
def test_no_shuffle_files_stay(spark, how):
    before = shuffle_files(spark)
    rows = spark.range(10_000).withColumn("n", F.count("*").over(Window.partitionBy(F.col("id") % 10)))
    kept = KEEPERS[how](rows)
    assert shuffle_files(spark) <= before
    assert kept.agg(F.sum("n")).first()[0] == 10_000 * 1000
