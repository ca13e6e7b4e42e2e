"""The pipeline's stages, one by one and together, against plain versions."""

import zlib

import pytest

import corpus_pipeline
from taleloom.llm.quality import score

from .test_decontaminate import plain
from .test_lines import all_pairs
from .test_packing import check
from .test_simhash import groups, plain_fingerprint


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """The rows after each stage, each written and read again."""
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, small).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_names_and_columns(spark, small, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing",
    ]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for df in stages[:-1]:
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in docs.schema]


def test_quality_stage(spark, small, stages):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    scores = {r.doc_id: r.score for r in score(docs, spark.read.parquet(f"{small}/labels.parquet")).collect()}
    before, after = texts(docs), texts(stages[0])
    assert after == {d: t for d, t in before.items() if scores[d] >= 0.3} and 0 < len(after) < len(before)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    held = [d for d in before if labels.get(d) == 1 and zlib.crc32(str(d).encode()) % 5 == 0]
    assert held and set(held) <= set(after)  # accuracy is tested on a larger table


def test_line_stage(stages):
    before, after = texts(stages[0]), texts(stages[1])
    want = all_pairs(list(before.items()))
    assert after == {d: want[d, t] for d, t in before.items()}
    assert all(r.n_chars == len(r.text) for r in stages[1].collect())


def test_near_copy_stage(stages):
    before, after = texts(stages[1]), texts(stages[2])
    fps = {d: plain_fingerprint(t, 3) for d, t in before.items()}
    label = groups(sorted(fps), lambda a, b: bin((fps[a] ^ fps[b]) % 2**64).count("1") <= 2)
    assert after == {d: t for d, t in before.items() if label[d] == d}


def test_benchmark_stage(spark, small, stages):
    before, after = texts(stages[2]), texts(stages[3])
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    bad = {d for d, n, hit, _ in plain(list(before.items()), items) if hit and 20 * hit >= n}
    assert bad and after == {d: t for d, t in before.items() if d not in bad}


def test_packing_stage(stages):
    check(stages[4].collect(), list(texts(stages[3]).items()))


def test_run_gives_the_same(spark, small, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ran = corpus_pipeline.run(spark, small).select(columns).collect()
    assert sorted(map(tuple, ran)) == sorted(map(tuple, stages[4].select(columns).collect()))


def test_stages_take_empty_tables_and_odd_columns(spark, small):
    odd = spark.createDataFrame(
        [(1, None, "en", "s", 0, 1, "x"), (None, "", None, None, None, None, None)],
        "doc_id long, text string, lang string, source string, n_chars long, fp int, row string",
    )
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, small)
        assert got.columns == odd.columns and 0 <= got.count() <= 2
        assert stage(spark, odd.limit(0), small).count() == 0
