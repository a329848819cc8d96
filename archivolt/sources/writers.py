"""Writers: JSON, TSV, per-key files, append-only logs with a size cap, swaps and sweeps."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=False)


def safe_name(c: Column) -> Column:
    """A key as a file name."""
    return F.replace(F.replace(c, F.lit("/"), F.lit("_")), F.lit(".."), F.lit("_"))


def write_per_key(df: DataFrame, key: str, path: str) -> None:
    """One directory per key, partitioned by the safe form of the key."""
    df.withColumn("key", safe_name(F.col(key).cast("string"))).write.mode("overwrite").partitionBy("key").json(path)


def append_jsonl(df: DataFrame, path: str, cap_bytes: int = 50 * 1024 * 1024) -> bool:
    """Append, unless the log has reached its cap already; says whether it was written."""
    fs, p = _fs(df.sparkSession, path)
    if fs.exists(p) and fs.getContentSummary(p).getLength() >= cap_bytes:
        return False
    df.write.mode("append").json(path)
    return True


def swap(df: DataFrame, path: str) -> None:
    """Write beside, then put in place: readers see the old table or the new one.

    The old table is kept until the new one stands, so ``df`` may read it.
    """
    spark = df.sparkSession
    tmp, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(tmp)
    fs, p = _fs(spark, path)
    new_p, old_p = spark._jvm.org.apache.hadoop.fs.Path(tmp), spark._jvm.org.apache.hadoop.fs.Path(old)
    if fs.exists(p):
        fs.rename(p, old_p)
    fs.rename(new_p, p)
    if fs.exists(old_p):
        fs.delete(old_p, True)


def upsert(current: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """The latest row of every key by ``version``; on a tie the change wins."""
    both = current.withColumn("__n", F.lit(0)).unionByName(changes.withColumn("__n", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in both.columns if c not in (key, "__n")]
    return both.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(version, "__n")).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in cols])


def stale_files(listing: DataFrame, keep: DataFrame, stem: str = "stem") -> DataFrame:
    """Files whose stem is not kept any more."""
    return listing.join(keep.select(stem).distinct(), stem, "left_anti")


def sweep(spark: SparkSession, paths: DataFrame) -> int:
    """Delete the files listed in column ``path``; streamed to the driver, which deletes through the file system."""
    n = 0
    for r in paths.select("path").toLocalIterator():
        fs, p = _fs(spark, r["path"])
        n += bool(fs.delete(p, False))
    return n
