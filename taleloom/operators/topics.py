"""Topics by online variational rounds over a table of words.

The model is a table ``word, m0 .. m(k-1)``; neither words nor their weights reach the
driver, which keeps ``k`` topic totals. Every text belongs to one round. A round

1. lists which words each block of its texts needs, and joins the model to them;
2. brings a block's texts and weights together, where topic shares of the texts are
   iterated to their fixed point and expected word counts per topic added up;
3. adds these counts up by word, as a stored table, and moves the topic totals.

The stored tables are bucketed by word, all alike, so that the rounds after read them where
they are: only the words a round needs are shuffled to them, not every earlier sum again.

Updates decay all earlier weights alike, so a weight is ``decay * (start + sum) + floor``
with two numbers per round for the whole model: a round stores sums of its own words
only. The start is a hash of word and topic, so words need no row before they occur.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleloom.session import cut_lineage, ensure_checkpoint_dir, shuffles_removed

BLOCK_WORDS = 400_000
MERGE_AFTER = 6
# Words of a bucket of the stored tables, and the fewest buckets.
BUCKET_WORDS = 250_000
LEAST_BUCKETS = 8
RUN_ENTRIES = 8192
STEPS = 60
CLOSE = 1e-3


def digamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, "f8"), np.zeros(np.shape(x))
    for _ in range(6):
        small = x < 6
        out -= np.where(small, 1 / x, 0)
        x = x + small
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


def _log_shares(weights: np.ndarray, totals: np.ndarray) -> np.ndarray:
    return digamma(weights) - digamma(totals)


def fit_block(
    text: np.ndarray, word: np.ndarray, n: np.ndarray, n_texts: int, weights: np.ndarray, totals: np.ndarray, alpha: float
) -> np.ndarray:
    """Expected counts per word and topic of texts given as ``text, word, n`` entries sorted by text.

    ``weights`` has a row per word and a column per topic.
    """
    k = weights.shape[1]
    beta = np.exp(_log_shares(weights, totals))
    filled, first, length = np.unique(text, return_index=True, return_counts=True)
    ends = first + length
    # Texts go through in runs of some entries, whose weights stay in the processor's cache.
    runs, start = [], 0
    while start < len(filled):
        stop = max(start + 1, int(np.searchsorted(ends, first[start] + RUN_ENTRIES, "right")))
        rows, here = slice(start, stop), slice(first[start], ends[stop - 1])
        runs.append((rows, length[rows], first[rows] - first[start], n[here], beta[word[here]]))
        start = stop

    def ratios(theta: np.ndarray, run: tuple) -> np.ndarray:
        rows, lengths, _, count, weight = run
        return count / np.maximum(np.einsum("ij,ij->i", np.repeat(theta[rows], lengths, axis=0), weight), 1e-100)

    gamma = np.ones((n_texts, k))
    for _ in range(STEPS):
        theta = np.exp(_log_shares(gamma, gamma.sum(axis=1, keepdims=True)))
        found, own = np.zeros((n_texts, k)), theta[filled]
        for run in runs:
            found[filled[run[0]]] = np.add.reduceat(ratios(own, run)[:, None] * run[4], run[2], axis=0)
        new = alpha + theta * found
        moved = np.abs(new - gamma).mean()
        gamma = new
        if moved < CLOSE:
            break
    theta = np.exp(_log_shares(gamma, gamma.sum(axis=1, keepdims=True)))
    ratio = np.concatenate([ratios(theta[filled], run) for run in runs]) if runs else np.zeros(0)
    return np.stack([np.bincount(word, ratio * theta[text, t], len(weights)) for t in range(k)], axis=1) * beta


def _start(word: Column, topic: int, seed: int) -> Column:
    """A number around 1 from a hash of word and topic."""
    return 0.9 + 0.2 * F.pmod(F.xxhash64(word, F.lit(topic), F.lit(seed)), F.lit(1 << 20)) / (1 << 20)


def _summed(tables: list[DataFrame], names: list[str]) -> DataFrame:
    rows = tables[0]
    for table in tables[1:]:
        rows = rows.unionByName(table)
    return rows.groupBy("word").agg(*(F.sum(c).alias(c) for c in names)) if len(tables) > 1 else rows


def _bucketed(table: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """``table`` stored in the checkpoint folder, bucketed by word: the bucketed table, and the same as plain files.

    Joins read the first. A union of bucketed tables, grouped by word, gave a word several rows in Spark 4.1; it reads the second.
    """
    spark, name = table.sparkSession, f"topic_words_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark)}/tables/{name}"
    with shuffles_removed(spark):
        table.write.format("parquet").bucketBy(buckets, "word").option("path", path).saveAsTable(name)
    return spark.table(name), spark.read.schema(table.schema).parquet(path)


def _with_sums(needed: DataFrame, tables: list[DataFrame], names: list[str]) -> DataFrame:
    """``needed`` with the sums of its words over all tables; a word without sums has zeros.

    Tables may be small enough for a broadcast, but a run would send all of them through the driver many times.
    """
    sums = [F.lit(0.0)] * len(names)
    for i, table in enumerate(tables):
        here = [f"{c}_{i}" for c in names]
        needed = needed.join(table.select("word", *(F.col(c).alias(h) for c, h in zip(names, here))).hint("merge"), "word", "left")
        sums = [a + F.coalesce(c, F.lit(0.0)) for a, c in zip(sums, here)]
    return needed.select("block", "word", *(a.alias(c) for a, c in zip(sums, names)))


def topics(
    df: DataFrame,
    words: Column,
    k: int = 7,
    top: int = 10,
    rounds: int = 20,
    seed: int = 42,
    delay: float = 2.0,
    power: float = 0.7,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``topic, place, word, weight``: the heaviest words of each topic, as shares of the topic.

    Every word of every text takes part, each text in one of the rounds; null lists are
    empty. ``delay`` and ``power`` set how fast the rounds' weight falls: ``(delay + round) ** -power``.
    """
    alpha = eta = 1 / k
    names = [f"m{t}" for t in range(k)]
    numbered = df.select(words.alias("words")).filter(F.size("words") > 0).withColumn("text", F.monotonically_increasing_id())
    turn = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(rounds)).cast("int")
    # A folder per round, as each round would otherwise read the texts of all.
    bags = cut_lineage(numbered.withColumn("round", turn), by="round")
    sizes = bags.groupBy("round").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.size("words")).alias("words"))
    per_round = {r["round"]: (r["texts"], r["words"]) for r in sizes.collect()}  # a row per round
    n_texts = sum(t for t, _ in per_round.values())
    vocabulary = bags.select(F.explode("words").alias("word")).distinct()
    first = vocabulary.agg(F.count(F.lit(1)), *(F.sum(_start(F.col("word"), t, seed)) for t in range(k))).first()
    buckets = max(LEAST_BUCKETS, -(-first[0] // BUCKET_WORDS))
    n_words, start = first[0], np.array([x or 0.0 for x in first[1:]], "f8")

    tables: list[tuple[DataFrame, DataFrame]] = []
    summed = np.zeros(k)
    decay, floor = 1.0, 0.0
    for step, turn_no in enumerate(sorted(per_round)):
        texts, total_words = per_round[turn_no]
        rho = (delay + step) ** -power
        totals = decay * (start + summed) + floor * n_words
        blocks = max(1, -(-total_words // block_words))
        block = F.pmod(F.xxhash64("text", F.lit("block")), F.lit(blocks))
        batch = bags.filter(F.col("round") == turn_no).withColumn("block", block).select("block", "text", "words")
        needed = batch.select("block", F.explode("words").alias("word")).distinct()
        weights = [decay * _start(F.col("word"), t, seed) + floor for t in range(k)]
        if tables:
            needed = _with_sums(needed, [t for t, _ in tables], names)
            weights = [w + decay * F.col(c) for w, c in zip(weights, names)]
        model = needed.select(F.col("block").alias("part"), "word", *(w.alias(c) for w, c in zip(weights, names)))

        def expected(texts_of: pa.Table, model_of: pa.Table) -> pa.Table:
            lists = texts_of["words"].combine_chunks()
            known = model_of["word"].combine_chunks()
            word = pc.index_in(lists.flatten(), value_set=known).to_numpy(zero_copy_only=False).astype("i8")
            text = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            entry, n = np.unique(text * max(len(known), 1) + word, return_counts=True)
            text, word = np.divmod(entry, max(len(known), 1))
            rows = np.stack([model_of[c].to_numpy() for c in names], axis=1)
            out = fit_block(text, word, n.astype("f8"), len(lists), rows, totals, alpha)
            return pa.table({"word": known, **{c: out[:, t] for t, c in enumerate(names)}})

        kind = "word string, " + ", ".join(f"{c} double" for c in names)
        counted = batch.groupBy("block").cogroup(model.groupBy("part")).applyInArrow(expected, kind)
        after = decay * (1 - rho)
        scale = rho * n_texts / texts / after
        table = counted.groupBy("word").agg(*((F.sum(c) * scale).alias(c) for c in names))
        tables.append(_bucketed(table, buckets))
        moved = tables[-1][1].agg(*(F.sum(c) for c in names)).first()
        summed = summed + np.array([x or 0.0 for x in moved], "f8")
        decay, floor = after, (1 - rho) * floor + rho * eta
        if len(tables) > MERGE_AFTER:
            tables = [_bucketed(_summed([t for _, t in tables], names), buckets)]

    spark = df.sparkSession
    if not tables:
        return spark.createDataFrame([], "topic int, place int, word string, weight double")
    totals = decay * (start + summed) + floor * n_words
    weights = [
        F.struct(
            F.lit(t).alias("topic"),
            ((decay * (_start(F.col("word"), t, seed) + F.col(c)) + floor) / float(totals[t])).alias("weight"),
        )
        for t, c in enumerate(names)
    ]
    rows = _summed([t for _, t in tables], names).select("word", F.inline(F.array(*weights)))
    # Tasks cut their lists before the shuffle.
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "word"))
    ranked = rows.withColumn("place", place - 1).filter(F.col("place") < top)
    return ranked.select("topic", "place", "word", "weight")
