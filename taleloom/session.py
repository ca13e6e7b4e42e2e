"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
    initial_partitions: int = 4096,
) -> SparkSession:
    """A session with UTC time, adaptive execution, skew-join splitting and stream state on disk.

    ``master`` and ``shuffle_partitions`` are left to the cluster's own
    configuration when they are not given.
    """
    builder = (
        SparkSession.builder.appName("taleloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Many small partitions at first; adaptive execution joins them by measured size.
        .config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(initial_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.filterPushdown", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cpus: int | str = 8) -> SparkSession:
    """The session used by tests and the benchmark."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    return build_session(
        f"local[{cpus}]",
        8,
        {
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
        initial_partitions=8,
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder named by the session; a private one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
        return named
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    own = tempfile.mkdtemp(prefix="taleloom-ckpt-")
    sc.setCheckpointDir(own)
    return own


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """A write in here drops its shuffle files when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def cut_lineage(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the stored table.

    With ``by`` each value of that column gets a folder, and a filter on it reads no other rows.

    A loop that joins its own checkpointed frames hands their inferred
    constraints from round to round until planning takes longer than the work;
    a stored table starts afresh.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def cut_in_parts(parts: Iterable[DataFrame]) -> DataFrame:
    """As ``cut_lineage`` of the union of one part or more, written one after another: only one part's shuffles are on disk."""
    path = None
    for part in parts:
        spark, schema = part.sparkSession, part.schema
        path = path or f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
        with shuffles_removed(spark):
            part.write.option("compression", "zstd").mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def remove_stored(table: DataFrame) -> None:
    """Delete a table of ``cut_lineage`` that nothing reads any more."""
    jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
    for name in table.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name)).getParent()
        folder.getFileSystem(conf).delete(folder, True)
