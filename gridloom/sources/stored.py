"""Tables built once from source files and read back while the files stay as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def source_mark(source: DataFrame) -> str:
    """A mark of a table of files: it changes when a file is added, removed or written anew. Reads no column of the table."""
    files = source.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    mark = files.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*files.columns)).alias("h")).first()
    return f"{mark['n']}-{(mark['h'] or 0) % 2**64:016x}"


def stored_path(source: DataFrame, folder: str, name: str) -> str:
    return f"{folder}/{name}-{source_mark(source)}"


def is_stale(source: DataFrame, folder: str, name: str) -> bool:
    """True if nothing is stored for the source as it is now."""
    return not exists(source.sparkSession, f"{stored_path(source, folder, name)}/_SUCCESS")


def build_once(source: DataFrame, folder: str, name: str, build: Callable[[DataFrame], DataFrame], rebuild: bool = False) -> DataFrame:
    """build(source), written to ``folder`` the first time and read from there while the source's files stay the same."""
    path = stored_path(source, folder, name)
    if rebuild or not exists(source.sparkSession, f"{path}/_SUCCESS"):
        build(source).write.mode("overwrite").parquet(path)
    return source.sparkSession.read.parquet(path)
