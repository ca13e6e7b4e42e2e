"""Pages arriving over time: each address is processed at most once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from taleloom.operators.pages import page_stories
from taleloom.tables import SCHEMAS

# Fixed value: addresses that contain this hold one story per page.
SINGLE_STORY_URL = "grimm"


def page_stream(spark: SparkSession, path: str, glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """New page files in a folder."""
    reader = spark.readStream.schema(SCHEMAS["pages"]).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def once_per_url(pages: DataFrame) -> DataFrame:
    """Each address once, over the whole life of the stream."""
    return pages.dropDuplicates(["url"])


def once_per_url_within(pages: DataFrame, fetched: str, delay: str) -> DataFrame:
    """Each address once per time span; the state of older addresses is dropped.

    The time column is cast, since a watermark needs a time zone.
    """
    timed = pages.withColumn(fetched, F.col(fetched).cast("timestamp"))
    return timed.withWatermark(fetched, delay).dropDuplicatesWithinWatermark(["url"])


def ingest_within(pages: DataFrame, fetched: str, delay: str, out: str, checkpoint: str) -> int:
    """Store the pages that are new within a time span; gives the number of rows that came too late to tell.

    Takes up what has arrived and stops. The watermark lets addresses go that were seen longer ago than ``delay``
    before the latest page, so the state is bounded by the pages of that span; rows older than the watermark are
    dropped and counted.
    """
    job = (
        once_per_url_within(pages, fetched, delay)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    return sum(s["numRowsDroppedByWatermark"] for p in job.recentProgress for s in p["stateOperators"])


def ingest_stories(
    pages: DataFrame, out: str, checkpoint: str, single_story_url: str = SINGLE_STORY_URL
) -> StreamingQuery:
    """Extract the stories of unseen pages and store them; stops when the input is used up.

    Every micro-batch overwrites its own folder, so a repeated batch leaves the
    same rows.
    """

    def store(batch: DataFrame, batch_no: int) -> None:
        page_stories(batch, single_story_url).write.mode("overwrite").parquet(f"{out}/batch_no={batch_no}")

    return (
        once_per_url(pages)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
