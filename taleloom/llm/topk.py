"""Exact top-k search by inner product.

Vectors are dealt into shards of bounded size and queries into tiles of bounded
size; each pair of a tile and a shard meets in one task as one matrix product,
which keeps the best ``k`` of the shard for each query (partial selection). The
lists of a query are then merged in a tree of bounded fan-in, so that no task
sees more than ``fan_in * k`` entries of a query, however many shards there are.

Components are turned into ``floor(scale * x)``; scores are whole numbers and
must fit in a long. Products run in doubles where no sum can pass 2^53, in
64-bit integers otherwise.

Defined results: vectors that are null, or hold null or non-finite components,
and rows of a null id take no part; ties go to the smaller id; every row counts,
repeated ones as often as they are there, and the list of an id holds the best
partners of all its rows; an id is never its own result; vectors of different
lengths never meet; fewer than ``k`` candidates give a shorter list; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1024
SHARD_ROWS = 16384
TILE_ROWS = 2048
FAN_IN = 16


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v`` with whole-number components, of the rows that take part."""
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
        .filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & finite)
        .select("vec_id", F.transform("e", lambda x: F.floor(x * scale).cast("bigint")).alias("v"))
    )


def copies(rows: DataFrame, most: int) -> DataFrame:
    """``vec_id, v, copy`` of the rows; more than ``most`` copies of a row can fill no further place of a list."""
    counted = rows.groupBy("vec_id", "v").agg(F.least(F.count(F.lit(1)), F.lit(most)).cast("int").alias("n"))
    return counted.select("vec_id", "v", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))


def _product(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
    if top < 2**53:
        return np.rint(queries.astype("f8") @ rows.astype("f8").T).astype("i8")
    return queries @ rows.T


def _best(scores: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the best ``k`` candidates of each query, as ``(query, candidate)`` pairs.

    ``ids`` ascend, so that the first of equal scores has the smaller id. Every
    candidate as good as the ``k``-th is kept until ties are settled.
    """
    scores = np.where(own, np.iinfo("i8").min, scores)
    if len(ids) > k:
        kth = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
        q, c = np.nonzero((scores >= kth[:, None]) & ~own)
    else:
        q, c = np.nonzero(~own)
    order = np.lexsort((ids[c], -scores[q, c], q))
    q, c = q[order], c[order]
    first = np.searchsorted(q, np.arange(scores.shape[0]))
    keep = np.arange(len(q)) - first[q] < k
    return q[keep], c[keep]


def _search(k: int, tiles: int):
    def tile_by_shard(tile: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(tile) and len(shard):
            lengths = shard["v"].map(len)
            for n, some in tile.groupby(tile["v"].map(len)):
                rows = shard[lengths == n].sort_values("vec_id")
                if not len(rows):
                    continue
                ids = rows["vec_id"].to_numpy("i8")
                own = some["vec_id"].to_numpy("i8")[:, None] == ids[None, :]
                matrix = np.stack([np.asarray(x, "i8") for x in rows["v"]]).reshape(len(rows), n)
                asked = np.stack([np.asarray(x, "i8") for x in some["v"]]).reshape(len(some), n)
                scores = _product(asked, matrix)
                q, c = _best(scores, own, ids, k)
                found.append(
                    pd.DataFrame(
                        {
                            "query_id": some["vec_id"].to_numpy("i8")[q],
                            "part": np.int64(shard["part"].iloc[0]) * tiles + np.int64(tile["tile"].iloc[0]),
                            "vec_id": ids[c],
                            "score": scores[q, c],
                        }
                    )
                )
        if not found:
            return pd.DataFrame({c: np.zeros(0, "i8") for c in ("query_id", "part", "vec_id", "score")})
        hits = pd.concat(found).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return hits.groupby("query_id").head(k)

    return tile_by_shard


def merge_lists(lists: DataFrame, parts: int, k: int, fan_in: int = FAN_IN) -> DataFrame:
    """``query_id, best``: the lists of ``query_id, part, vec_id, score`` rows merged in a tree."""
    entry = F.struct((-F.col("score")).alias("neg"), "vec_id")
    merged = lists.groupBy("query_id", "part").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("best"))
    while parts > 1:
        parts = -(-parts // fan_in)
        merged = (
            merged.withColumn("part", F.floor(F.col("part") / fan_in))
            .groupBy("query_id", "part")
            .agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        )
    return merged.select("query_id", "best")


def top_k(
    vectors: DataFrame,
    is_query,
    k: int = 10,
    scale: int = SCALE,
    shard_rows: int = SHARD_ROWS,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best partners of each query id, from rank 1.

    ``is_query`` is a condition on ``vec_id``.
    """
    rows = copies(whole_vectors(vectors, scale), k)
    total, asked = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    parts, tiles = max(1, -(-total // shard_rows)), max(1, -(-asked // tile_rows))
    row = F.xxhash64("vec_id", "v", "copy")
    shards = rows.withColumn("part", F.pmod(row, F.lit(parts))).withColumn(
        "tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(tiles - 1).cast("bigint")))
    )
    grid = rows.filter(is_query).withColumn("tile", F.pmod(row, F.lit(tiles))).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))
    )
    lists = (
        grid.groupBy("tile", "part")
        .cogroup(shards.groupBy("tile", "part"))
        .applyInPandas(_search(k, tiles), "query_id long, part long, vec_id long, score long")
    )
    return merge_lists(lists, parts * tiles, k).select(
        "query_id", F.posexplode("best").alias("place", "hit")
    ).select(
        "query_id",
        (F.col("place") + 1).alias("rank"),
        F.col("hit.vec_id").alias("vec_id"),
        (-F.col("hit.neg")).alias("score"),
    )
