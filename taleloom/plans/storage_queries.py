"""Sources and sinks: tables written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from taleloom import tables
from taleloom.operators import catalogue as cat
from taleloom.operators import metrics as met
from taleloom.operators import pages as pg
from taleloom.operators import sampling as smp
from taleloom.plans.catalogue_queries import GUIDE
from taleloom.plans import page_queries  # noqa: F401
from taleloom.plans.metric_queries import PREDS, predictions
from taleloom.plans.registry import LABELLED, ORACLES, STORIES, TAGGED, VECS, ctes, query
from taleloom.plans.relational_queries import MEANS
from taleloom.plans.sampling_queries import RANKED, SEED, SPLIT_80_10_10, labelled
from taleloom.session import ensure_checkpoint_dir
from taleloom.sources import exports, readers, store
from taleloom.streaming import ingest


def fresh_folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files/{uuid.uuid4().hex}"


@query(
    "a2_story_lines",
    ctes(STORIES, GUIDE) + "SELECT atu, \"desc\", title, origin, text, url FROM guide",
)
def a2_story_lines(spark, sf_dir):
    path = fresh_folder(spark)
    rows = cat.guide_stories(tables.guide(spark, sf_dir)).select("atu", "desc", "title", "origin", "text", "url")
    exports.write_stories(rows, path)
    return readers.read_story_lines(spark, path)


@query(
    "a4_catalogue_csv",
    ctes(STORIES)
    + """SELECT atu_raw AS "ATU", origin AS "Origin", title AS "Book Title", text AS content, 'catalogue-' || story_id AS name,
  language AS "Language" FROM stories WHERE from_xml""",
)
def a4_catalogue_csv(spark, sf_dir):
    path = fresh_folder(spark)
    rows = tables.catalogue(spark, sf_dir).drop("story_id")
    exports.write_catalogue(rows, path)
    return readers.read_catalogue(spark, path)


@query(
    "a5_keyed_tables",
    ctes(STORIES) + "SELECT story_id, title, origin, length(text) AS n_chars FROM stories WHERE language = 'German'",
)
def a5_keyed_tables(spark, sf_dir):
    kept = store.TableStore(spark, fresh_folder(spark))
    kept.write("default", tables.stories(spark, sf_dir).select("story_id", "title", "origin", "text", "language"))
    narrowed = kept.read("default").filter("language = 'German'")
    kept.write("default", narrowed)
    return kept.read("default").select("story_id", "title", "origin", F.length("text").cast("bigint").alias("n_chars"))


@query(
    "a6_cached_dataset",
    ctes(STORIES, TAGGED, LABELLED, RANKED)
    + """SELECT story_id, label_id, CASE WHEN pos < (n * 20 + 99) // 100 THEN 'test' ELSE 'train' END AS split FROM ranked
WHERE NOT pos < (n * 20 + 99) // 100""",
)
def a6_cached_dataset(spark, sf_dir):
    root = fresh_folder(spark)

    def build():
        return smp.class_split(labelled(spark, sf_dir), "label_id", "story_id", 20, SEED)

    store.cached_dataset(spark, root, "base", 0, 0.2, build)
    again = store.cached_dataset(spark, root, "base", 0, 0.2, build)
    return again.filter(F.col("split") == "train").select("story_id", "label_id", "split")


@query(
    "a10_stored_split",
    ctes(STORIES, TAGGED, LABELLED, RANKED, SPLIT_80_10_10)
    + "SELECT split, label_id, count(*) AS n, min(story_id) AS first_id FROM split GROUP BY split, label_id",
)
def a10_stored_split(spark, sf_dir):
    root = fresh_folder(spark)

    def build():
        return smp.stratified_split(labelled(spark, sf_dir), "label_id", "story_id", "80_10_10", SEED)

    store.stored_split(spark, root, "80_10_10", build, SEED)
    stored = store.stored_split(spark, root, "80_10_10", build, SEED)
    return stored.groupBy("split", "label_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("story_id").alias("first_id")
    )


@query(
    "a9_confusion_wide",
    ctes(VECS, MEANS, PREDS)
    + """SELECT t.label, p.pred, (SELECT count(*) FROM preds x WHERE x.label = t.label AND x.pred = p.pred) AS n
FROM (SELECT DISTINCT label FROM preds) t, (SELECT DISTINCT pred FROM preds) p""",
)
def a9_confusion_wide(spark, sf_dir):
    """The wide matrix as CSV, read back and unpivoted."""
    path = fresh_folder(spark)
    counts = met.confusion_counts(predictions(spark, sf_dir), "label", "pred")
    wide = met.confusion_wide(counts, "label", "pred")
    wide.write.csv(path, header=True)
    classes = [c for c in wide.columns if c != "label"]
    schema = ", ".join(["label int", *(f"`{c}` bigint" for c in classes)])
    stored = spark.read.schema(schema).csv(path, header=True)
    cells = [F.struct(F.lit(c).cast("int").alias("pred"), F.col(f"`{c}`").alias("n")) for c in classes]
    return stored.select("label", F.inline(F.array(*cells)))


@query(
    "a1_text_tree",
    """SELECT source AS folklore, doc_id, length(text) AS n_chars FROM documents
WHERE doc_id % 2 = 0 OR NOT EXISTS (SELECT 1 FROM documents d WHERE d.source = documents.source AND d.doc_id % 14 = 0)""",
)
def a1_text_tree(spark, sf_dir):
    """Books with a split folder consist of that folder's files; the loose files of the others count."""
    root = fresh_folder(spark)
    docs = tables.load(spark, sf_dir, "documents").select("source", "doc_id", F.length("text").alias("n_chars"))
    lines = docs.select("source", "doc_id", F.to_json(F.struct("doc_id", "n_chars")).alias("value"))
    has_split = lines.filter(F.col("doc_id") % 14 == 0).select("source").distinct()
    books = lines.withColumn("book", F.regexp_replace("source", "[^A-Za-z0-9]", "_"))
    in_split = books.join(has_split, "source", "left_semi").filter(F.col("doc_id") % 2 == 0).withColumn("split tales", F.lit("a"))
    loose = books.join(has_split, "source", "left_anti").unionByName(
        books.join(has_split, "source", "left_semi").filter(F.col("doc_id") % 2 != 0)
    )
    loose.select("book", "value").write.partitionBy("book").mode("append").text(root)
    in_split.select("book", "split tales", "value").write.partitionBy("book", "split tales").mode("append").text(root)
    found = readers.read_text_tree(spark, root).select("folklore", F.explode(F.split(F.trim("content"), "\n")).alias("line"))
    parsed = found.filter("line <> ''").select(
        F.regexp_replace("folklore", "^book=", "").alias("folklore"),
        F.from_json("line", "doc_id bigint, n_chars bigint").alias("d"),
    )
    return parsed.select("folklore", "d.*")


@query(
    "a3_song_array",
    "SELECT CAST(conv_id AS VARCHAR) AS songid, role AS title, text AS lyric FROM conversations WHERE text <> ''",
)
def a3_song_array(spark, sf_dir):
    """Songs in files of one JSON array each; a file holds the turns of fifty conversations."""
    path = fresh_folder(spark)
    turns = tables.load(spark, sf_dir, "conversations").withColumn("batch", F.floor(F.col("conv_id") / 50))
    song = F.struct(F.col("conv_id").cast("string").alias("songid"), F.col("role").alias("title"), F.col("text").alias("lyric"))
    arrays = turns.groupBy("batch").agg(F.to_json(F.collect_list(song)).alias("value"))
    arrays.write.partitionBy("batch").text(path)
    return readers.read_songs(spark, f"{path}/*").filter(F.length("lyric") > 0).select("songid", "title", "lyric")


@query(
    "a11_label_file",
    "SELECT DISTINCT source AS label_name, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS label_id FROM documents",
)
def a11_label_file(spark, sf_dir):
    """A ``name->id`` line per source."""
    path = fresh_folder(spark)
    names = tables.load(spark, sf_dir, "documents").select("source").distinct()
    names.select(F.concat("source", F.lit("->"), F.regexp_extract("source", "([0-9]+)$", 1)).alias("value")).write.text(path)
    return readers.read_label_dictionary(spark, path)


@query(
    "a13_once_within",
    """SELECT url, count(*) + count(*) FILTER (WHERE page_id % 2 = 0) AS visits,
  (SELECT count(*) FROM pages WHERE page_id % 5 = 0) AS late_rows FROM pages GROUP BY url""",
)
def a13_once_within(spark, sf_dir):
    """Three runs: all pages; some again at once and some too late; some again after their time has passed."""
    source, out, checkpoint = (fresh_folder(spark) for _ in range(3))
    pages = tables.load(spark, sf_dir, "pages").select("page_id", "url")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")

    def at(seconds):
        return start + F.make_dt_interval(secs=seconds + F.col("page_id") % 1000)

    late = pages.filter(F.col("page_id") % 5 == 0).select("page_id", F.concat("url", F.lit("?late")).alias("url"))
    runs = [
        pages.withColumn("fetched", at(F.lit(200_000))),
        pages.filter(F.col("page_id") % 3 == 0).withColumn("fetched", at(F.lit(220_000))).unionByName(
            late.withColumn("fetched", at(F.lit(0)))
        ),
        pages.filter(F.col("page_id") % 2 == 0).withColumn("fetched", at(F.lit(221_000))),
    ]
    dropped = 0
    for rows in runs:
        rows.select("url", "fetched").write.mode("append").parquet(source)
        stream = spark.readStream.schema("url string, fetched timestamp_ntz").parquet(source)
        dropped += ingest.ingest_within(stream, "fetched", "5000 seconds", out, checkpoint)
    stored = spark.read.schema("url string, fetched timestamp").parquet(out)
    return stored.groupBy("url").agg(F.count(F.lit(1)).alias("visits")).withColumn("late_rows", F.lit(dropped).cast("bigint"))


# A pattern, which a stream follows to one file as well as to a folder of files.
PAGES = "/pages[.]parquet"


@query("a13_stream_once", "SELECT DISTINCT url FROM pages")
def a13_stream_once(spark, sf_dir):
    """Every page arrives twice; each address leaves once."""
    out, checkpoint = fresh_folder(spark), fresh_folder(spark)
    twice = ingest.page_stream(spark, sf_dir + PAGES).select("url")
    twice = twice.union(ingest.page_stream(spark, sf_dir + PAGES).select("url"))
    job = (
        ingest.once_per_url(twice)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    return spark.read.schema("url string").parquet(out)


@query("a13_stream_stories", ORACLES["b3_page_stories"])
def a13_stream_stories(spark, sf_dir):
    out = fresh_folder(spark)
    job = ingest.ingest_stories(ingest.page_stream(spark, sf_dir + PAGES), out, fresh_folder(spark), "/(en|de)/")
    job.awaitTermination()
    schema = pg.page_stories(tables.load(spark, sf_dir, "pages"), "x").schema
    return spark.read.schema(schema).parquet(f"{out}/batch_no=*")
