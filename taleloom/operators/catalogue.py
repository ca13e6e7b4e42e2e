"""Cleaning the second catalogue and merging it with the guide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleloom.functions.codes import (
    LABEL_NAMES,
    NOT_FOUND,
    category,
    label_name,
    trim_code,
)
from taleloom.functions.text import base_name

LONGEST_CODE = 6


def with_category(df: DataFrame, code: str = "atu_raw", name: str = "category") -> DataFrame:
    return df.withColumn(name, category(F.col(code)))


def valid_codes(df: DataFrame, code: str = "atu_raw") -> DataFrame:
    """Rows whose code has a category."""
    return df.filter(category(F.col(code)) != NOT_FOUND)


def known_category(df: DataFrame, name: str = "category") -> DataFrame:
    """Rows whose category is not the marker for unknown; null categories stay."""
    return df.filter(~F.col(name).eqNullSafe(F.lit(NOT_FOUND)))


def several_codes(df: DataFrame, code: str) -> DataFrame:
    """Rows that name several codes, kept aside."""
    return df.filter(F.col(code).contains(","))


def single_short_codes(df: DataFrame, code: str) -> DataFrame:
    """Rows with one code of fewer than six characters, before any trimming."""
    return df.filter(~F.col(code).contains(",") & (F.length(code) < LONGEST_CODE))


def code_descriptions(guide: DataFrame, code: str, description: str, row_no: str) -> DataFrame:
    """One description per code: that of the last row, null included."""
    last = F.max_by(F.struct(description), row_no).getField(description)
    return guide.filter(F.col(code).isNotNull()).groupBy(code).agg(last.alias(description))


def clean_catalogue(guide: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The second catalogue in the common story schema.

    Codes are looked up as they stand and trimmed afterwards. The lookup has one
    row per code: adaptive execution broadcasts it when it is small, and splits
    the partitions of very common codes otherwise.
    """
    lookup = code_descriptions(guide, "atu_raw", "description", "story_id").select(
        F.col("atu_raw").alias("ATU"), F.col("description").alias("desc")
    )
    kept = single_short_codes(catalogue, "ATU")
    return kept.join(lookup, "ATU", "left").select(
        "story_id",
        trim_code(F.col("ATU")).alias("atu"),
        "desc",
        F.col("Book Title").alias("title"),
        F.col("Origin").alias("origin"),
        F.col("content").alias("text"),
        F.col("name").alias("url"),
        F.lit(True).alias("from_xml"),
        F.col("Language").alias("language"),
    )


def guide_stories(guide: DataFrame) -> DataFrame:
    """Guide rows in the common story schema, with their constant columns."""
    return guide.select(
        "story_id",
        F.col("atu_raw").alias("atu"),
        F.col("description").alias("desc"),
        "title",
        "origin",
        "text",
        F.concat(F.lit("guide-"), F.col("story_id").cast("string")).alias("url"),
        F.lit(False).alias("from_xml"),
        F.lit("English").alias("language"),
    )


def label_dimension(df: DataFrame) -> DataFrame:
    """The seven label names and ids as a table."""
    rows = ", ".join(f"('{name}', {number})" for name, number in LABEL_NAMES.items())
    return df.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS labels(label_name, label_id)")


def encode_labels(df: DataFrame, labels: DataFrame, name: str = "category") -> DataFrame:
    """Add ``label_id`` for a category; the dictionary has seven rows and is broadcast."""
    named = df.withColumn("label_name", label_name(F.col(name)))
    return named.join(F.broadcast(labels), "label_name", "left")


def decode_labels(df: DataFrame, labels: DataFrame, number: str, out: str) -> DataFrame:
    names = labels.select(F.col("label_id").alias(number), F.col("label_name").alias(out))
    return df.join(F.broadcast(names), number, "left")


def promote_book(df: DataFrame, nested: str, excluded: list[str]) -> DataFrame:
    """``folklore, text, path`` of a text tree.

    The parts of one nested book become books of their own, then the books named
    in ``excluded`` are left out.
    """
    parts = F.split("path", "/")
    book = F.element_at(parts, 1)
    promoted = F.when((book == nested) & (F.size(parts) > 2), F.get(parts, F.lit(1))).otherwise(book)
    return df.select(
        promoted.alias("folklore"), base_name(F.col("path")).alias("text"), "path"
    ).filter(~F.col("folklore").isin([nested, *excluded]))
