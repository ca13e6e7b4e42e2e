"""Reading scraped stories, songs, catalogues, label files and text trees."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STORY_SCHEMA = "atu STRING, desc STRING, title STRING, origin STRING, text STRING, url STRING"
SONG_SCHEMA = "songid STRING, title STRING, lyric STRING"
REGION_SONG_SCHEMA = "region STRING, title STRING, lyric STRING, lyric_eng STRING"
CATALOGUE_SCHEMA = (
    "ATU STRING, Origin STRING, `Book Title` STRING, content STRING, name STRING, Language STRING"
)
SPLIT_FOLDER = "split "
HIDDEN_FOLDER = ".ipynb_checkpoints"


def read_story_lines(spark: SparkSession, path: str) -> DataFrame:
    """Scraped stories, one JSON object per line."""
    return spark.read.schema(STORY_SCHEMA).json(path)


def read_songs(spark: SparkSession, path: str, schema: str = SONG_SCHEMA) -> DataFrame:
    """Scraped songs; each file is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_catalogue(spark: SparkSession, path: str, schema: str = CATALOGUE_SCHEMA) -> DataFrame:
    """The second catalogue: CSV whose quoted texts run over several lines."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_label_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``label_name, label_id`` from ``name->id`` lines."""
    parts = F.split("value", "->")
    return (
        spark.read.text(path)
        .filter(F.col("value").contains("->"))
        .select(F.trim(parts.getItem(0)).alias("label_name"), F.trim(parts.getItem(1)).cast("int").alias("label_id"))
    )


def _relative(path: Column, root: str) -> Column:
    """A file address below a folder."""
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    return F.regexp_replace(path, rf"^[a-z0-9]*:?/*\Q{base}\E/", "")


def text_tree_files(spark: SparkSession, root: str) -> DataFrame:
    """``folklore, text, path, file``: the text files of each book, chosen by their addresses alone.

    A book with a ``split ...`` folder consists of that folder's files alone.
    Files of other sub-folders do not belong to a book.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("file"))
    rows = files.withColumn("path", _relative(F.col("file"), root)).withColumn("parts", F.split("path", "/"))
    folder = F.get("parts", F.lit(1))
    is_split = (F.size("parts") == 3) & F.lower(folder).startswith(SPLIT_FOLDER)
    placed = rows.filter((F.size("parts") == 2) | is_split).select(
        F.get("parts", F.lit(0)).alias("folklore"),
        F.element_at("parts", -1).alias("text"),
        "path",
        "file",
        F.when(is_split, folder).alias("split_folder"),
    ).filter(F.col("folklore") != HIDDEN_FOLDER)
    chosen = placed.groupBy("folklore").agg(F.max("split_folder").alias("chosen_folder"))
    return (
        placed.join(chosen, "folklore")
        .filter(F.col("chosen_folder").isNull() | (F.col("split_folder") == F.col("chosen_folder")))
        .select("folklore", "text", "path", "file")
    )


def read_text_tree(spark: SparkSession, root: str) -> DataFrame:
    """``folklore, text, path, content``: one row per text file below the book folders.

    Only the chosen files are opened, and their contents are not shuffled. The driver holds the chosen
    addresses, as it does those of any folder that Spark reads.
    """
    names = [r["file"] for r in text_tree_files(spark, root).select("file").collect()]
    if not names:
        return spark.createDataFrame([], "folklore string, text string, path string, content string")
    exact = [re.sub(r"([\\*?\[\]{}])", r"\\\1", name) for name in names]  # an address may look like a pattern
    address = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    path = _relative(address, root)
    return spark.read.text(exact, wholetext=True).select(
        F.element_at(F.split(path, "/"), 1).alias("folklore"),
        F.element_at(F.split(path, "/"), -1).alias("text"),
        path.alias("path"),
        F.col("value").alias("content"),
    )
