"""Cutting up very common join keys.

Adaptive execution splits skewed joins by itself, but not where the next step
groups by the same key, since the split would cost it a shuffle. There the
common keys are cut up beforehand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 1000


def hot_keys(sizes: DataFrame, key: str, n: str, parts: int = PARTS) -> DataFrame:
    """``key, _cuts`` for keys with more than one ``parts``-th of all rows.

    There can be at most ``parts`` such keys, whatever the data, so the result
    may be broadcast. ``_cuts`` is the number of even pieces to cut a key into.
    """
    total = sizes.agg(F.sum(n)).scalar()
    weight = F.col(n) * F.lit(parts)
    return sizes.filter(F.col(key).isNotNull() & (weight > total)).select(
        key, F.ceil(weight / total).cast("int").alias("_cuts")
    )


def _cuts() -> Column:
    return F.coalesce("_cuts", F.lit(1))


def cut(df: DataFrame, hot: DataFrame, key: str, row_id: str) -> DataFrame:
    """Add ``_piece``: which piece of its key a row belongs to, by the hash of its id."""
    tagged = df.join(F.broadcast(hot), key, "left")
    return tagged.withColumn("_piece", F.pmod(F.xxhash64(row_id), _cuts()).cast("int")).drop("_cuts")


def repeated(lookup: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """A lookup with its few hot rows repeated for every piece: at most twice ``parts`` rows more."""
    tagged = lookup.join(F.broadcast(hot), key, "left")
    return tagged.withColumn("_piece", F.explode(F.sequence(F.lit(0), _cuts() - 1))).drop("_cuts")
