"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A side of a join is broadcast only when the optimizer's own size estimate stays below this.
BROADCAST_LIMIT_BYTES = 8 * 1024 * 1024


def build_session(app: str = "tillweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on; anything in conf wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the folder all executors share.

    The cluster names it in spark.checkpoint.dir. Only in a session on one machine may that be unset: then a
    temporary folder is set. Elsewhere each executor would write to a disk of its own, so that is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tillweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    path = os.path.join(base, f"{purpose}-{uuid.uuid4().hex}")
    # Made now so that the file system can be told to drop it when the session ends.
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def written(df: DataFrame, purpose: str, *partition_by: str) -> DataFrame:
    """Cut the lineage of df: write it to the shared folder and read it back.

    Unlike a local checkpoint this survives the loss of any executor, and the scan can be pruned.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of df (an upper bound for scans and filters without statistics)."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast only where the estimate proves the side small; else leave the choice to AQE."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if estimated_bytes(df) <= limit else df
