"""Session factory and the few session-level helpers operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every operator is written for; a cluster may override any of them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

#: Whether a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def make_session(app: str = "archivolt", master: str | None = None, **conf: str) -> SparkSession:
    """A session with :data:`DEFAULTS`; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a cluster ships it with ``--py-files``)."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in paths:
        env["PYTHONPATH"] = os.pathsep.join([here, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    ensure_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only on one machine
    (a ``local`` master) may it be unset, and a folder of our own is used;
    anywhere else that raises, since a machine's own folder is not shared.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        shared = os.path.join(tempfile.gettempdir(), "archivolt-checkpoints")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint, which survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_to_table(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder as parquet and read it back.

    Unlike :func:`cut` the result keeps parquet's column pruning and pushdown
    and its size is known to the planner. The shuffle files of the write go with
    it; otherwise they would stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _STAGES.append(path)
    return spark.read.parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table of :func:`cut_to_table` that nothing reads any more."""
    spark = df.sparkSession
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        own = next((s for s in _STAGES if re.sub("^file:/*", "/", path) == re.sub("^file:/*", "/", s)), None)
        if own:
            _STAGES.remove(own)
            p = spark._jvm.org.apache.hadoop.fs.Path(own)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_STAGES: list[str] = []


def drop_stages(spark: SparkSession) -> int:
    """Delete the stage tables this process has written; for when the results that read them have been stored."""
    n = 0
    while _STAGES:
        p = spark._jvm.org.apache.hadoop.fs.Path(_STAGES.pop())
        n += bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))
    return n


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table whose size has a bound, checked before use.

    Reads at most ``limit + 1`` rows; raises if the bound does not hold.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; this operator needs it bounded")
    return rows
