"""Session construction and cluster-facing helpers."""

from __future__ import annotations

import gc
import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tidemark") -> SparkSession:
    """Session with the settings every job here assumes.

    AQE is on so shuffle partition counts and join strategies are re-planned at
    run time (coalescing small partitions, splitting skewed ones).  The session
    time zone is pinned to UTC so dates derived from timestamps are stable.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may go without: a private folder is created and registered
    then.  On a cluster a missing setting is an error, as executors could not see
    each other's files.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = private_folder(spark.sparkContext.master)
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured


def private_folder(master: str) -> str:
    """A machine-local folder, for a master whose executors run in this process only."""
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tidemark-ckpt-")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never a
    machine-local path on a cluster)."""
    import uuid

    return f"{checkpoint_dir(spark).rstrip('/')}/tidemark-scratch/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss) into the shared folder.

    The frame is persisted while the checkpoint is taken: a reliable
    checkpoint otherwise computes its input twice (once for the eager count,
    once more to write the files).  The persisted copy is dropped right after;
    the result reads the checkpoint files."""
    from pyspark import StorageLevel

    checkpoint_dir(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return held.checkpoint(eager=True)
    finally:
        held.unpersist()



def free_finished(spark: SparkSession) -> None:
    """Let go of what no frame needs any more, above all the shuffle files behind a cut lineage.

    Spark deletes them once the driver has collected the objects that stand for them; a driver
    with little to do may not for half an hour.  To be called after a step that shuffled much."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
