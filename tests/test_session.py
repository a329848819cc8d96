import os

from pyspark.sql import functions as F

from archivolt.session import cut_to_table, drop_table


def test_a_stage_table_leaves_no_shuffle_files(spark):
    """The shuffle of a stage is gone once its table is written, and so is a table that is dropped."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f and f.endswith(".data")}
    before = files()
    got = cut_to_table(spark.range(1000).groupBy(F.xxhash64("id").alias("k")).agg(F.max("id").alias("id")), "small")
    assert not files() - before
    assert got.count() == 1000
    path = got.inputFiles()[0].removeprefix("file://")
    drop_table(got)
    assert not os.path.exists(path)
