"""Small file-system helpers that work on any Hadoop path."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished write has left its marker in the folder."""
    target, fs = _hadoop(spark, f"{path}/_SUCCESS")
    return fs.exists(target)


def child_names(spark: SparkSession, path: str) -> list[str]:
    target, fs = _hadoop(spark, path)
    if not fs.exists(target):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(target))
