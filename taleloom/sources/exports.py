"""Written results: vector lines, matrices, predictions, stories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleloom.functions.codes import display_key
from taleloom.operators.features import mean_vectors
from taleloom.operators.metrics import confusion_wide


def vector_lines(df: DataFrame, code: str, description: str, vector: str) -> DataFrame:
    """``meta, mean``: ``code(description)`` and mean vector of each group; null keys are dropped."""
    known = df.dropna(subset=[code, description, vector])
    means = mean_vectors(known, [code, description], vector)
    return means.select(display_key(F.col(code), F.col(description)).alias("meta"), "mean")


def write_vector_lines(lines: DataFrame, path: str) -> None:
    """``<path>/vectors`` and ``<path>/meta``: text files whose lines correspond.

    Both are written from one table sorted by ``meta`` that is stored first, so
    that a lost task repeats the same rows in the same order.
    """
    spark = lines.sparkSession
    table = f"{path}/table"
    text = F.array_join(F.transform("mean", lambda v: v.cast("string")), "\t")
    spread = lines.select("meta", text.alias("vector")).repartitionByRange("meta")
    spread.sortWithinPartitions("meta").write.mode("overwrite").parquet(table)
    stored = spark.read.schema("meta string, vector string").parquet(table)
    stored.select(F.col("vector").alias("value")).write.mode("overwrite").text(f"{path}/vectors")
    stored.select(F.col("meta").alias("value")).write.mode("overwrite").text(f"{path}/meta")


def write_stories(rows: DataFrame, path: str) -> None:
    """Stories as JSON lines."""
    rows.write.mode("overwrite").json(path)


def write_confusion(matrix: DataFrame, truth: str, pred: str, classes: Sequence, path: str) -> None:
    """Confusion matrix as CSV: one named row per true class, one column per predicted class.

    The table has one row per class, which is why a single file is written.
    """
    wide = confusion_wide(matrix, truth, pred, classes)
    wide.orderBy(truth).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_predictions(df: DataFrame, row_id: str, pred: str, truth: str, path: str) -> None:
    df.select(row_id, F.col(pred).alias("y_pred"), F.col(truth).alias("y_true")).write.mode("overwrite").parquet(path)


def write_catalogue(rows: DataFrame, path: str) -> None:
    """CSV with quoted texts, as ``readers.read_catalogue`` takes it."""
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
