"""Session settings and fault-tolerant lineage cuts."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None, memory: str | None = None, **extra: str) -> SparkSession:
    """A session with this library's settings; on a cluster pass no master and let spark-submit decide."""
    builder = SparkSession.builder.appName("gridloom")
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a Spark context: functions of it are pickled by name, and workers may start in any folder or on any machine."""
    context = spark.sparkContext
    if getattr(context, "_gridloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if os.path.isdir(os.path.join(root, "gridloom")):  # a package that runs from an archive came with it
        folder = tempfile.mkdtemp(prefix="gridloom-package-")  # the driver serves the file from here as long as it runs
        context.addPyFile(shutil.make_archive(os.path.join(folder, "gridloom"), "zip", root, "gridloom"))
        owner = os.getpid()
        atexit.register(lambda: os.getpid() == owner and shutil.rmtree(folder, ignore_errors=True))
    context._gridloom_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in spark.checkpoint.dir; a local folder only where none is set and the master is local."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", context.master):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="gridloom-checkpoint-")
        owner = os.getpid()
        atexit.register(lambda: os.getpid() == owner and shutil.rmtree(shared, ignore_errors=True))
    context.setCheckpointDir(shared)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage; survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
