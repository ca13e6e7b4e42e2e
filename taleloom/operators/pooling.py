"""Attention pooling of the stories that share a code."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleloom.functions.keys import order_key
from taleloom.functions.vectors import scaled_dot
from taleloom.operators.features import mean_vectors
from taleloom.operators.skew import cut, hot_keys, repeated


Matrix = Sequence[Sequence[float]]


def projected(vector: Column, weights: Matrix | None) -> Column:
    """``weights @ vector``, or the vector itself without a matrix."""
    if weights is None:
        return vector
    matrix = np.asarray(weights, dtype=np.float64)

    @F.pandas_udf("array<double>")
    def apply(batch: pd.Series) -> pd.Series:
        return pd.Series(list(np.vstack(batch.to_numpy()) @ matrix.T), dtype="object")

    return apply(vector)


def attention_scores(
    df: DataFrame,
    code: str,
    row_id: str,
    vector: str,
    dim: int,
    heads: int,
    seed: int | str,
    matrices: tuple[Matrix | None, Matrix | None, Matrix | None] = (None, None, None),
) -> DataFrame:
    """``code, head, row_id, value, weight``: softmax weights before normalisation.

    One seeded story per code is the query. Each head sees its slice of the
    vector. The largest score of a code comes from a partial aggregate, not from
    a window over the whole code, and very common codes are joined in pieces.
    """
    if dim % heads:
        raise ValueError("the vector length must be a multiple of the number of heads")
    width = dim // heads
    rows = df.select(code, row_id, vector).filter(F.col(code).isNotNull() & F.col(vector).isNotNull())
    first = F.min(F.struct(order_key(seed, row_id).alias("k"), F.col(row_id).alias("id"))).getField("id")
    codes = rows.groupBy(code).agg(first.alias("_chosen"), F.count(F.lit(1)).alias("n"))
    hot = hot_keys(codes, code, "n")
    for_query, for_key, for_value = matrices
    chosen = codes.select(F.col("_chosen").alias(row_id))
    query = rows.join(chosen, row_id, "left_semi").select(
        code, projected(F.col(vector), for_query).alias("_query")
    )
    mapped = cut(rows, hot, code, row_id).select(
        code,
        "_piece",
        row_id,
        projected(F.col(vector), for_key).alias("_key"),
        projected(F.col(vector), for_value).alias("_value"),
    )
    head = F.explode(F.sequence(F.lit(0), F.lit(heads - 1)))
    per_head = mapped.join(repeated(query, hot, code), [code, "_piece"]).withColumn("head", head)
    start = F.col("head") * width + 1
    scored = per_head.select(
        code,
        "_piece",
        "head",
        row_id,
        F.slice("_value", start, width).alias("value"),
        scaled_dot(F.slice("_query", start, width), F.slice("_key", start, width)).alias("_score"),
    )
    top = scored.groupBy(code, "head").agg(F.max("_score").alias("_top"))
    return scored.join(repeated(top, hot, code), [code, "head", "_piece"]).select(
        code, "head", row_id, "value", F.exp(F.col("_score") - F.col("_top")).alias("weight")
    )


def attention_pool(
    df: DataFrame, code: str, row_id: str, vector: str, dim: int, heads: int, seed, matrices=(None, None, None)
) -> DataFrame:
    """``code, emb, n``: the heads' weighted means, side by side.

    ``matrices`` project query, key and value; without them vectors are used as
    they are.
    """
    scores = attention_scores(df, code, row_id, vector, dim, heads, seed, matrices)
    means = mean_vectors(scores, [code, "head"], "value", weight="weight")
    ordered = F.array_sort(F.collect_list(F.struct("head", "mean")))
    return means.groupBy(code).agg(ordered.alias("_heads"), F.max("n").alias("n")).select(
        code, F.flatten(F.col("_heads.mean")).alias("emb"), "n"
    )


def attention_weights(
    df: DataFrame, code: str, row_id: str, vector: str, dim: int, heads: int, seed, matrices=(None, None, None)
) -> DataFrame:
    """``code, head, row_id, weight`` with weights that sum to 1 per code and head."""
    scores = attention_scores(df, code, row_id, vector, dim, heads, seed, matrices).select(
        code, "head", row_id, "weight"
    )
    whole = scores.groupBy(code, "head").agg(F.sum("weight").alias("_sum"))
    return scores.join(whole, [code, "head"]).select(
        code, "head", row_id, (F.col("weight") / F.col("_sum")).alias("weight")
    )
