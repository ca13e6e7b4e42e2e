import json
import os

import pytest
from pyspark.sql import functions as F

from taleloom import tables
from taleloom.operators import metrics as met
from taleloom.plans import QUERIES
from taleloom.sources import exports, readers, store
from taleloom.streaming import ingest


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_text_tree(spark, tmp_path):
    root = tmp_path / "my tree"
    put(root / "Book A" / "one.txt", "first\nline")
    put(root / "Book A" / "two + half.txt", "second")
    put(root / "Book B" / "whole.txt", "loose")
    put(root / "Book B" / "Split by tale" / "x.txt", "x")
    put(root / "Book B" / "Split by tale" / "ü.txt", "y")
    put(root / "Book A" / ".ipynb_checkpoints" / "c.txt", "hidden")
    got = {(r.folklore, r.text): (r.path, r.content) for r in readers.read_text_tree(spark, str(root)).collect()}
    assert got == {
        ("Book A", "one.txt"): ("Book A/one.txt", "first\nline"),
        ("Book A", "two + half.txt"): ("Book A/two + half.txt", "second"),
        ("Book B", "x.txt"): ("Book B/Split by tale/x.txt", "x"),
        ("Book B", "ü.txt"): ("Book B/Split by tale/ü.txt", "y"),
    }


def test_text_tree_opens_only_chosen_files(spark, tmp_path):
    put(tmp_path / "A [x]" / "o*e {1}.txt", "kept")
    put(tmp_path / "A [x]" / "one {1}.txt", "too")
    put(tmp_path / "B" / "loose.txt", "left out")
    put(tmp_path / "B" / "split a" / "t.txt", "split")
    tree = readers.read_text_tree(spark, str(tmp_path))
    plan = tree._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and len(tree.inputFiles()) == 3
    assert sorted(r.content for r in tree.collect()) == ["kept", "split", "too"]
    files = readers.text_tree_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in files
    (tmp_path / "none").mkdir()
    assert readers.read_text_tree(spark, str(tmp_path / "none")).count() == 0


def test_songs_are_one_json_array(spark, tmp_path):
    put(tmp_path / "songs.jl", json.dumps([{"songid": "1", "title": "A", "lyric": ""}, {"songid": "2", "title": "B", "lyric": "la"}], indent=1))
    songs = readers.read_songs(spark, str(tmp_path / "songs.jl"))
    assert [r.songid for r in songs.filter(F.length("lyric") > 0).collect()] == ["2"]
    put(tmp_path / "archive.jl", json.dumps([{"region": "N", "title": "A", "lyric": "x", "lyric_eng": "y"}]))
    archive = readers.read_songs(spark, str(tmp_path / "archive.jl"), readers.REGION_SONG_SCHEMA)
    assert archive.first().asDict() == {"region": "N", "title": "A", "lyric": "x", "lyric_eng": "y"}


def test_story_lines(spark, tmp_path):
    put(tmp_path / "s.jl", json.dumps({"atu": "1", "desc": "d", "title": "t", "origin": "o", "text": "a\nb", "url": "u"}) + "\n")
    assert readers.read_story_lines(spark, str(tmp_path / "s.jl")).first().text == "a\nb"


def test_catalogue_csv(spark, tmp_path):
    put(tmp_path / "c.csv", 'ATU,Origin,Book Title,content,name,Language\n510A,Italy,"T, 1"," He said ""no"".\nThen left. ",n.xml,English\n')
    row = readers.read_catalogue(spark, str(tmp_path / "c.csv")).first()
    assert row["Book Title"] == "T, 1" and row.content == ' He said "no".\nThen left. '


def test_label_dictionary(spark, tmp_path):
    put(tmp_path / "m.txt", "Anecdotes and Jokes->0\nStupid Ogre->5\n\n")
    got = {r.label_name: r.label_id for r in readers.read_label_dictionary(spark, str(tmp_path / "m.txt")).collect()}
    assert got == {"Anecdotes and Jokes": 0, "Stupid Ogre": 5}


def test_table_store(spark, tmp_path):
    kept = store.TableStore(spark, str(tmp_path / "store"))
    kept.write("a", spark.range(5))
    kept.write("a", kept.read("a").filter("id > 2"))
    kept.write("b", spark.range(1))
    assert kept.read("a").count() == 2 and kept.keys() == ["a", "b"]
    os.makedirs(tmp_path / "store" / "a" / "v00000003")  # a write that did not finish
    assert kept.read("a").count() == 2
    with pytest.raises(KeyError):
        kept.read("c")


def test_dataset_and_split_are_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(10).select("id", F.when(F.col("id") < 2, "test").otherwise("train").alias("split"))

    for _ in range(2):
        data = store.cached_dataset(spark, str(tmp_path), "arch", 10, 0.2, build)
        split = store.stored_split(spark, str(tmp_path), "80_20_0", build)
    assert len(calls) == 2 and data.filter("split = 'test'").count() == 2 and split.count() == 10
    plan = data.filter("split = 'test'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_vector_lines_correspond(spark, tmp_path):
    df = spark.createDataFrame([(str(i % 50), f"d{i % 50}", [float(i % 50), 1.0]) for i in range(200)], "c string, d string, v array<double>")
    exports.write_vector_lines(exports.vector_lines(df, "c", "d", "v"), str(tmp_path / "out"))

    def lines(folder):
        files = sorted(p for p in os.listdir(tmp_path / "out" / folder) if p.startswith("part"))
        return [line for f in files for line in (tmp_path / "out" / folder / f).read_text().splitlines()]

    meta, vectors = lines("meta"), lines("vectors")
    assert len(meta) == len(vectors) == 50
    assert all(float(v.split("\t")[0]) == float(m.split("(")[0]) for m, v in zip(meta, vectors))


def test_confusion_csv_and_predictions(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 1, 1)], "id long, y int, p int")
    exports.write_confusion(met.confusion_counts(df, "y", "p"), "y", "p", [0, 1], str(tmp_path / "cm"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "cm")).orderBy("y").collect()] == [("0", "1", "1"), ("1", "0", "1")]
    exports.write_predictions(df, "id", "p", "y", str(tmp_path / "pred"))
    assert spark.read.parquet(str(tmp_path / "pred")).columns == ["id", "y_pred", "y_true"]


def test_stream_takes_each_url_once(spark, small, tmp_path):
    pages = tables.load(spark, small, "pages").limit(40)
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    pages.coalesce(1).write.parquet(folder)
    pages.coalesce(1).write.mode("append").parquet(folder)

    def run():
        ingest.ingest_stories(ingest.page_stream(spark, folder, files_per_batch=1), out, mark, "/(en|de)/").awaitTermination()
        return spark.read.parquet(out).select("url")

    first = run()
    assert first.count() == first.distinct().count() == 40
    # A restart sees only the new file, and only its unseen addresses.
    pages.withColumn("url", F.concat("url", F.when(F.col("page_id") < 5, "#new").otherwise(""))).coalesce(1).write.mode("append").parquet(folder)
    again = run()
    assert again.count() == 45


def test_bounded_stream_state(spark, tmp_path):
    rows = spark.range(20).select(
        F.concat(F.lit("u"), (F.col("id") % 5).cast("string")).alias("url"),
        F.expr("cast(timestamp'2024-01-01 00:00:00' as timestamp_ntz)").alias("fetched"),
    )
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    job = ingest.once_per_url_within(stream, "fetched", "1 hour").writeStream.format("memory").queryName("once_within").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "mark")).start()
    job.awaitTermination()
    assert spark.table("once_within").count() == 5


@pytest.mark.parametrize("files", [1, 3])
def test_streamed_table_is_a_file_or_a_folder(spark, tmp_path, files):
    rows = [(i, f"http://a.org/en/{i}", f"<html><body><h1>title {i}</h1><p>text {i}</p></body></html>") for i in range(12)]
    pages = spark.createDataFrame(rows, tables.SCHEMAS["pages"])
    if files == 1:
        pages.toPandas().to_parquet(tmp_path / "pages.parquet")
    else:
        pages.repartition(files).write.parquet(str(tmp_path / "pages.parquet"))
    assert {r.url for r in QUERIES["a13_stream_once"](spark, str(tmp_path)).collect()} == {r[1] for r in rows}
    assert QUERIES["a13_stream_stories"](spark, str(tmp_path)).count() == 12
