"""Keyed tables, cached datasets and stored splits, all kept as Parquet folders."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from taleloom.sources.paths import child_names, is_complete


class TableStore:
    """Tables under named keys.

    Each write makes a new version folder, so that a table may be read and
    replaced in the same job, and a write that failed leaves the old one in use.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def _versions(self, key: str) -> list[str]:
        folder = f"{self.root}/{key}"
        names = [n for n in child_names(self.spark, folder) if n.startswith("v")]
        return [f"{folder}/{n}" for n in sorted(names)]

    def keys(self) -> list[str]:
        return [k for k in child_names(self.spark, self.root) if any(
            is_complete(self.spark, v) for v in self._versions(k)
        )]

    def write(self, key: str, df: DataFrame) -> None:
        """Two writers at a time make a version each; which is read is settled by name."""
        path = f"{self.root}/{key}/v{len(self._versions(key)) + 1:08d}-{uuid.uuid4().hex}"
        df.write.parquet(path)

    def read(self, key: str) -> DataFrame:
        done = [v for v in self._versions(key) if is_complete(self.spark, v)]
        if not done:
            raise KeyError(key)
        return self.spark.read.parquet(done[-1])


def dataset_path(root: str, arch: str, min_group: int, test_ratio: float) -> str:
    return f"{root.rstrip('/')}/{arch}/filter-{min_group}_test-{test_ratio}"


def cached_dataset(
    spark: SparkSession,
    root: str,
    arch: str,
    min_group: int,
    test_ratio: float,
    build: Callable[[], DataFrame],
) -> DataFrame:
    """The dataset for these parameters, built once and stored by split."""
    path = dataset_path(root, arch, min_group, test_ratio)
    if not is_complete(spark, path):
        build().write.mode("overwrite").partitionBy("split").parquet(path)
    return spark.read.parquet(path)


def stored_split(
    spark: SparkSession, root: str, spec: str, build: Callable[[], DataFrame], seed: int | str = 0
) -> DataFrame:
    """The ``id, split`` table of a split spec and seed, drawn once and then reused."""
    path = f"{root.rstrip('/')}/{spec}_seed-{seed}"
    if not is_complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
