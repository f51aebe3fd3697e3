"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(
    app_name: str = "tidepanel", cores: str = "*", partitions: int = 8, folder: str | None = None
) -> SparkSession:
    """Single-machine session used by tests and the benchmark; ``folder`` takes its checkpoints."""
    builder = SparkSession.builder
    if folder is not None:
        builder = builder.config("spark.checkpoint.dir", folder)
    session = (
        builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir, which driver and executors share.

    Only a session on one machine without that setting gets a temporary folder; on a cluster
    a missing setting is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            # local and local[8] run in one process; local-cluster does not.
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("Set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="tidepanel-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpoint(frame: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_root(frame.sparkSession)
    return frame.checkpoint()


def working_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for tables one job writes and the next one reads."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str = "rows") -> DataFrame:
    """Written as compressed Parquet into a new shared folder and read again.

    For frames of many rows: a checkpoint writes them as they lie in memory, several times their size.
    """
    folder = working_folder(frame.sparkSession, name)
    frame.write.option("compression", "zstd").parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)
