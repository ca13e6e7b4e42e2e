"""Exact positions without sorting a whole group in one task.

``row_number() OVER (PARTITION BY label ...)`` puts every row of a label into
one task. Here each group is cut into buckets that follow the wanted order; the
buckets are counted, the counts are summed up to give each bucket its start,
and only the rows inside one bucket are sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleloom.functions.keys import hash_bucket, order_key

ID_SPAN = 65536


def positions(
    df: DataFrame,
    order: Sequence[str],
    bucket: Column,
    groups: Sequence[str] = (),
    name: str = "pos",
    size: str | None = None,
    per_group: DataFrame | None = None,
) -> DataFrame:
    """Add the 0-based position of each row within its group.

    ``bucket`` must not decrease along ``order``. Group columns must not be
    null. ``size`` names a column for the group's row count, and ``per_group``
    brings further columns of the groups; both travel with the bucket starts, so
    that no row is ever joined on its (possibly very common) group alone.
    """
    tagged = df.withColumn("_bucket", bucket)
    counts = tagged.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *groups,
        "_bucket",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
        *([F.sum("_rows").over(whole).alias(size)] if size else []),
    )
    if per_group is not None:
        starts = starts.join(per_group, list(groups))
    inside = Window.partitionBy(*groups, "_bucket").orderBy(*order)
    return (
        tagged.join(starts, [*groups, "_bucket"])
        .withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_start")
    )


def shuffled_positions(
    df: DataFrame,
    row_id: str,
    seed: int | str,
    groups: Sequence[str] = (),
    name: str = "pos",
    size: str | None = None,
    per_group: DataFrame | None = None,
) -> DataFrame:
    """Positions in the seeded random order of ``row_id``."""
    keyed = df.withColumn("_key", order_key(seed, row_id))
    bucket = hash_bucket(F.col("_key"))
    return positions(keyed, ["_key", row_id], bucket, groups, name, size, per_group).drop("_key")


def id_positions(df: DataFrame, row_id: str, groups: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """Positions in the order of a unique whole-number id."""
    return positions(df, [row_id], F.floor(F.col(row_id) / ID_SPAN), groups, name)


def group_sizes(df: DataFrame, label: str) -> DataFrame:
    """``label, n, start, total, class_no``: size of each class and its place in label order.

    One row per class; the windows see only these few rows.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    ordered = Window.orderBy(label)
    return sizes.select(
        label,
        "n",
        (F.sum("n").over(ordered) - F.col("n")).alias("start"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
        (F.row_number().over(ordered) - 1).cast("bigint").alias("class_no"),
    )
