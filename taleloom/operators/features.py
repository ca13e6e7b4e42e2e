"""Tokens, vocabularies, TF-IDF and hashed text vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleloom.functions import text as tx
from taleloom.functions.keys import hash_number
from taleloom.functions.text import BLANKS
from taleloom.functions.vectors import NORM_FLOOR
from taleloom.operators.ranking import shuffled_positions

PAD_ID = 0
UNKNOWN_ID = 1
FIRST_ID = 2


def sentence_rows(df: DataFrame, row_id: str, text: str) -> DataFrame:
    return df.select(row_id, F.posexplode(tx.sentences(F.col(text))).alias("pos", "sentence"))


def token_rows(df: DataFrame, row_id: str, tokens: Column) -> DataFrame:
    """A row per token; a text without tokens gives one row of nulls."""
    return df.select(row_id, F.posexplode_outer(tokens).alias("pos", "token"))


def padded(ids: Column, length: int) -> tuple[Column, Column]:
    """Ids filled up to ``length``, and the mask that tells real ids from padding."""
    size = F.size(ids)
    gap = F.lit(length) - size
    filled = F.concat(ids, F.array_repeat(F.lit(PAD_ID).cast("bigint"), gap))
    mask = F.concat(F.array_repeat(F.lit(1), size), F.array_repeat(F.lit(0), gap))
    return filled, mask


def hashed_token_ids(df: DataFrame, text: str, seq_len: int, vocab_size: int) -> DataFrame:
    """Add ``input_ids`` and ``attention_mask``; an id is the token's hash.

    Each row is encoded by itself: no vocabulary, no join, no shuffle.
    """
    kept = F.slice(tx.tokens(F.col(text)), 1, seq_len)
    ids = F.transform(kept, lambda t: FIRST_ID + hash_number(t, 1, 8, vocab_size - FIRST_ID))
    filled, mask = padded(F.col("_ids"), seq_len)
    return (
        df.withColumn("_ids", ids)
        .withColumn("input_ids", filled)
        .withColumn("attention_mask", mask)
        .drop("_ids")
    )


def vocabulary(df: DataFrame, text: str, min_count: int = 1) -> DataFrame:
    """``token, n, vocab_id``: distinct tokens numbered in the order of their hash."""
    counts = (
        df.select(F.explode(tx.tokens(F.col(text))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_count)
    )
    placed = shuffled_positions(counts, "token", "vocab", name="vocab_id")
    return placed.withColumn("vocab_id", F.col("vocab_id") + FIRST_ID)


def vocabulary_token_ids(df: DataFrame, row_id: str, text: str, vocab: DataFrame, seq_len: int) -> DataFrame:
    """``row_id, input_ids, attention_mask`` with ids looked up in a vocabulary.

    The vocabulary has one row per token: adaptive execution broadcasts it when
    it is small, and splits the partitions of very common tokens otherwise.
    """
    kept = F.slice(tx.tokens(F.col(text)), 1, seq_len)
    rows = token_rows(df, row_id, kept)
    ids = rows.join(vocab.select("token", "vocab_id"), "token", "left")
    spots = ids.select(row_id, "pos", F.coalesce("vocab_id", F.lit(UNKNOWN_ID)).alias("id"))
    # A text without tokens has one spot without a place, which is dropped here again.
    some = F.filter(F.collect_list(F.struct("pos", "id")), lambda s: s.pos.isNotNull())
    placed = spots.groupBy(row_id).agg(F.array_sort(some).alias("_placed"))
    filled, mask = padded(F.col("_ids"), seq_len)
    return placed.withColumn("_ids", F.col("_placed.id")).select(
        row_id, filled.alias("input_ids"), mask.alias("attention_mask")
    )


def tfidf(df: DataFrame, row_id: str, words: Column) -> DataFrame:
    """``row_id, token, tf, df, tfidf`` with ``idf = ln((1 + texts) / (1 + df))``.

    A text's words are counted inside its row. Only then one record per text and
    distinct token goes to the join. The other side has one row per token:
    adaptive execution broadcasts it when it is small, and splits the partitions
    of very common tokens otherwise.
    """
    counts = df.select(row_id, F.explode(tx.term_counts(words)).alias("t")).select(row_id, "t.token", "t.tf")
    texts = df.select(F.count(F.lit(1))).scalar()
    spread = counts.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((1 + texts) / (1 + F.col("df")))
    return counts.join(spread, "token").select(row_id, "token", "tf", "df", (F.col("tf") * idf).alias("tfidf"))


def tfidf_map(df: DataFrame, row_id: str, words: Column) -> DataFrame:
    """``row_id, tfidf``: token to weight, one map per text; a text without words has an empty one."""
    pairs = F.map_from_entries(F.collect_list(F.struct("token", "tfidf")))
    maps = tfidf(df, row_id, words).groupBy(row_id).agg(pairs.alias("tfidf"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return df.select(row_id).join(maps, row_id, "left").withColumn("tfidf", F.coalesce("tfidf", empty))


def _hashing_reader(dim: int) -> Callable[[np.ndarray], np.ndarray]:
    """A function from the parts of one text to the mean of their unit vectors."""
    blanks = re.compile(BLANKS)

    @lru_cache(maxsize=1 << 17)
    def mark(token: str) -> int:
        digest = hashlib.md5(token.encode()).hexdigest()
        return int(digest[:8], 16) % dim * 2 + (digest[8] >= "8")

    def read(parts: np.ndarray) -> np.ndarray:
        if parts is None or not len(parts):
            return np.zeros(dim)
        words = [[w for w in blanks.split(part) if w] for part in parts]
        marks = np.array([mark(w) for some in words for w in some], dtype=np.int64)
        part_no = np.repeat(np.arange(len(words)), [len(some) for some in words])
        sums = np.bincount(
            part_no * dim + (marks >> 1), weights=1 - 2 * (marks & 1), minlength=len(words) * dim
        ).reshape(len(words), dim)
        lengths = np.maximum(np.sqrt((sums * sums).sum(axis=1)), NORM_FLOOR)
        return (sums / lengths[:, None]).mean(axis=0)

    return read


def hashed_mean(parts: Column, dim: int) -> Column:
    """Mean of the hashed vectors of a text's parts.

    Each token of a part adds +1 or -1 to one of ``dim`` slots, and the sums are
    scaled to length 1. Nothing is shuffled: a text is encoded in the task that
    reads it, one Arrow batch at a time. Array expressions would walk the tokens
    once per slot, and exploding them would shuffle every token.
    """

    @F.arrow_udf("array<double>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        read = _hashing_reader(dim)
        for batch in batches:
            # A batch stays in Arrow; one text at a time becomes strings.
            rows = np.array([read(parts.as_py()) for parts in batch], "f8").reshape(-1, dim)
            ends = np.arange(len(batch) + 1, dtype="i4") * dim
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))

    return encode(F.transform(parts, F.lower))


def encode_hashed(df: DataFrame, ids: Sequence[str], text: str, dim: int, out: str = "embedding") -> DataFrame:
    """``ids, out``: the hashed vector of each row's whole text."""
    return df.select(*ids, hashed_mean(F.array_compact(F.array(text)), dim).alias(out))


Encoder = Callable[[list[str]], list[list[float]]]


def encode_with(df: DataFrame, row_id: str, text: str, load_encoder: Callable[[], Encoder]) -> DataFrame:
    """``row_id, embedding`` from a user's model, loaded once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load_encoder()
        for batch in batches:
            yield pd.DataFrame({row_id: batch[row_id], "embedding": encoder(batch[text].tolist())})

    id_type = df.schema[row_id].dataType.simpleString()
    return df.select(row_id, text).mapInPandas(run, f"{row_id} {id_type}, embedding array<double>")


def mean_vectors(
    df: DataFrame, keys: Sequence[str], vector: str, out: str = "mean", weight: str | None = None
) -> DataFrame:
    """``keys, out, n``: (weighted) mean vector per group, combined in each task first."""
    as_vector = array_to_vector(F.col(vector))
    mean = Summarizer.mean(as_vector, F.col(weight)) if weight else Summarizer.mean(as_vector)
    grouped = df.groupBy(*keys).agg(mean.alias("_mean"), F.count(F.lit(1)).alias("n"))
    return grouped.select(*keys, vector_to_array("_mean").alias(out), "n")


def sentence_mean_vectors(df: DataFrame, row_id: str, text: str, dim: int) -> DataFrame:
    """``row_id, mean, n``: mean of the hashed vectors of a text's sentences, row by row."""
    parts = df.select(row_id, tx.sentences(F.col(text)).alias("_parts"))
    return parts.select(
        row_id, hashed_mean(F.col("_parts"), dim).alias("mean"), F.size("_parts").cast("bigint").alias("n")
    )


ENCODERS = ("sbert", "lf")


def book_vectors(
    df: DataFrame, book: str, row_id: str, text: str, dim: int, method: str = "sbert", per_text: bool = False
) -> DataFrame:
    """One vector per book, or one per text of each book.

    ``sbert`` averages sentence vectors, ``lf`` encodes the whole text at once;
    the names are read without regard to case.
    """
    if method.lower() not in ENCODERS:
        raise ValueError(f"method must be one of {ENCODERS}")
    parts = tx.sentences(F.col(text)) if method.lower() == "sbert" else F.array_compact(F.array(text))
    named = df.select(book, row_id, hashed_mean(parts, dim).alias("embedding"))
    if per_text:
        return named.select(book, row_id, "embedding")
    return mean_vectors(named, [book], "embedding", out="embedding")
