"""Joins, grouped counts and set operations over story tables.

No join names its physical strategy: adaptive execution broadcasts a side when
its measured size allows, and otherwise shuffles and splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleloom.functions.keys import text_digest
from taleloom.operators.ranking import id_positions


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition in which a null key meets a null key."""
    out = F.lit(True)
    for key in keys:
        out = out & left[key].eqNullSafe(right[key])
    return out


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on every column the two tables share."""
    shared = [c for c in left.columns if c in right.columns]
    joined = left.join(right, null_safe(left, right, shared))
    return joined.select(*[left[c] for c in left.columns], *[right[c] for c in right.columns if c not in shared])


def key_digest(*columns: str) -> Column:
    """One short key for several nullable, possibly long columns."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("~")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def attach_vectors(
    stories: DataFrame, computed: DataFrame, keys: Sequence[str], vector: str, order: str
) -> DataFrame:
    """Stories with the vector computed for the same key.

    A key computed more than once keeps the vector of its smallest ``order``, so
    that no story is repeated. The long key columns travel as one digest, and
    vectors are fetched for the chosen rows only.
    """
    first = (
        computed.groupBy(key_digest(*keys).alias("_key")).agg(F.min(order).alias("_chosen"))
    )
    chosen = first.join(computed.select(F.col(order).alias("_chosen"), vector), "_chosen").drop("_chosen")
    return stories.withColumn("_key", key_digest(*keys)).join(chosen, "_key").drop("_key")


def attach_report(stories: DataFrame, computed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: stories in, stories out, and keys computed more than once."""
    per_key = computed.groupBy(key_digest(*keys).alias("_key")).agg(F.count(F.lit(1)).alias("_copies"))
    wanted = stories.groupBy(key_digest(*keys).alias("_key")).agg(F.count(F.lit(1)).alias("_stories"))
    return wanted.join(per_key, "_key", "full").agg(
        F.coalesce(F.sum("_stories"), F.lit(0)).alias("n_in"),
        F.coalesce(F.sum(F.when(F.col("_copies").isNotNull(), F.col("_stories"))), F.lit(0)).alias("n_out"),
        F.count(F.when(F.col("_copies") > 1, 1)).alias("n_dup_keys"),
    )


def in_texts(df: DataFrame, others: DataFrame, text: str) -> DataFrame:
    """Rows whose text occurs in another table, compared by digest."""
    seen = others.select(text_digest(F.col(text)).alias("_digest")).distinct()
    return df.withColumn("_digest", text_digest(F.col(text))).join(seen, "_digest", "left_semi").drop("_digest")


def in_ids(df: DataFrame, ids: DataFrame, row_id: str) -> DataFrame:
    return df.join(ids.select(row_id), row_id, "left_semi")


def unvisited(links: DataFrame, visited: DataFrame, key: str) -> DataFrame:
    return links.join(visited.select(key).distinct(), key, "left_anti")


def most_frequent(df: DataFrame, keys: Sequence[str], counted: str, k: int) -> DataFrame:
    """The ``k`` largest groups by non-null ``counted``; null keys are dropped."""
    known = df.dropna(subset=list(keys))
    counts = known.groupBy(*keys).agg(F.count(counted).alias("n"))
    return counts.orderBy(F.desc("n"), *keys).limit(k)


def groups_larger_than(df: DataFrame, key: str, size: int, inclusive: bool = False) -> DataFrame:
    """Rows of groups with more than ``size`` rows, or at least that many."""
    n = F.col("_n")
    sizes = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    kept = sizes.filter(n >= size if inclusive else n > size).select(key)
    return df.join(kept, key, "left_semi")


def shares(df: DataFrame, key: str) -> DataFrame:
    """``key, n, share``; the window sees one row per distinct key."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy())
    return counts.select(key, "n", (F.col("n") / whole).alias("share"))


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many distinct keys two tables share."""
    both = left.select(key).filter(F.col(key).isNotNull()).intersect(right.select(key))
    return both.agg(F.count(F.lit(1)).alias("n_shared"))


def stacked(first: DataFrame, second: DataFrame, row_id: str) -> DataFrame:
    """Both tables by column name, renumbered: the first table's rows come first."""
    tagged = first.withColumn("_source", F.lit(0)).unionByName(
        second.withColumn("_source", F.lit(1)), allowMissingColumns=True
    )
    placed = id_positions(tagged, row_id, ["_source"], "_pos")
    n_first = first.select(F.count(F.lit(1))).scalar()
    row_no = F.col("_pos") + F.when(F.col("_source") == 1, n_first).otherwise(0)
    return placed.withColumn("row_no", row_no).drop("_source", "_pos")
