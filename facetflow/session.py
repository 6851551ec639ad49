"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "facetflow", cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitter configures the session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and the master is local.

    On any other master an unset folder raises RuntimeError, as machines don't share their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-facetflow-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours, wherever the shared folder is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df written to the shared folder (within `folder`, if given) and read again: no lineage, and unlike a checkpoint neither its partitioning nor its constraints, so AQE may split a join of it and the planner has less to infer."""
    path = f"{folder or shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], overwrite: bool = False) -> DataFrame:
    """What is stored at path; made and stored first where there is nothing whole (a write that did not end has no _SUCCESS), or where overwrite asks for it. A table that is replaced is written beside it first, so it may be made from the old one."""
    jvm = spark._jvm.org.apache.hadoop.fs
    target = jvm.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if overwrite or not files.exists(jvm.Path(path, "_SUCCESS")):
        fresh = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
        make().write.parquet(fresh)
        files.delete(target, True)
        if not files.rename(jvm.Path(fresh), target):
            raise OSError(f"{fresh} can't be moved to {path}")
    return spark.read.parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
