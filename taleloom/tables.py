"""Input tables and the views derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Column types are declared so that no read has to infer them.
SCHEMAS = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, task_rows: int | None = None) -> DataFrame:
    """Rows of a table that arrives in fewer splits than there are cores, dealt out evenly.

    A table of cluster size has more splits than that and is left as it is, so
    the extra shuffle is only ever paid on small inputs. Work that takes long per row names
    ``task_rows``; a table in too few splits for that is dealt out at any size.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if task_rows:
        tasks = max(tasks, -(-df.count() // task_rows))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` for work that is heavy per text."""
    return spread(load(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def _story_code(doc_id: Column) -> tuple[Column, Column]:
    k = F.when(doc_id % 3 == 0, doc_id % 7).otherwise(doc_id % 61)
    return k, (k * 41).cast("string")


def stories(
    spark: SparkSession, sf_dir: str, vectors: bool = False, quality: bool = False, heavy: bool = False
) -> DataFrame:
    """The story table, derived from ``documents``.

    The joins to ``embeddings`` and ``labels`` are made only when a query asks
    for their columns, so that the others stay a single scan. ``heavy`` announces
    costly work on each text.
    """
    docs = load(spark, sf_dir, "documents")
    docs = spread(docs) if heavy else docs
    doc_id = F.col("doc_id")
    k, code = _story_code(doc_id)
    shape = doc_id % 17
    raw = (
        F.when(shape == 3, F.concat(code, F.lit("A")))
        .when(shape == 5, F.concat(F.lit("0"), code))
        .when(shape == 7, F.concat(code, F.lit("*")))
        .when(shape == 11, F.concat(code, F.lit(",12")))
        .when(shape == 13, F.lit("123456"))
        .otherwise(code)
    )
    language = (
        F.when(F.col("lang") == "en", "English")
        .when(F.col("lang") == "de", "German")
        .when(F.col("lang") == "fr", "French")
        .when(F.col("lang") == "es", "Spanish")
        .otherwise(F.col("lang"))
    )
    out = docs.select(
        doc_id.alias("story_id"),
        raw.alias("atu_raw"),
        F.when(k % 5 != 4, F.concat(F.lit("Tale type "), code)).alias("description"),
        F.substring("text", 1, 40).alias("title"),
        F.col("source").alias("origin"),
        "text",
        language.alias("language"),
        (doc_id % 4 == 0).alias("from_xml"),
    )
    if vectors:
        emb = load(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "story_id")
        out = out.join(emb, "story_id", "left")
    if quality:
        marks = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("story_id"), "quality")
        out = out.join(marks, "story_id", "left")
    return out


def guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that came from the guide pages."""
    return stories(spark, sf_dir).filter(~F.col("from_xml"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that came from the second catalogue, under its own column names."""
    return stories(spark, sf_dir).filter("from_xml").select(
        F.col("story_id"),
        F.col("atu_raw").alias("ATU"),
        F.col("origin").alias("Origin"),
        F.col("title").alias("Book Title"),
        F.col("text").alias("content"),
        F.concat(F.lit("catalogue-"), F.col("story_id").cast("string")).alias("name"),
        F.col("language").alias("Language"),
    )


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch losses per run, phase and epoch, derived from ``events``."""
    return load(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"),
        F.when(F.col("event_id") % 5 == 0, "valid").otherwise("train").alias("phase"),
        F.dayofmonth("ts").cast("bigint").alias("epoch"),
        F.col("event_id").alias("batch"),
        (F.col("value") / 100).alias("loss"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` with the vector widened to doubles."""
    return load(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label"
    )
