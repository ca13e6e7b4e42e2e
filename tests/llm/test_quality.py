"""The quality classifier: held-out accuracy, folds, and odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from taleloom.llm.quality import keep_good, score, text_statistics
from taleloom.llm.queries import QUERIES


def area(scores, labels):
    order = np.argsort(scores)
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    good = np.array(labels) == 1
    return (rank[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())


@pytest.fixture(scope="module")
def scored(spark):
    return QUERIES["op7_pu_quality"](spark, "/root/testdata/sf0.01").collect()


def test_held_out_accuracy(spark, scored):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    known = [r for r in scored if r.held_out and r.doc_id in labels]
    assert len(scored) == 1000 and all(0 <= r.score <= 1 for r in scored)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    assert all(r.predicted == (r.score >= 0.3) for r in scored)
    assert area([r.score for r in known], [labels[r.doc_id] for r in known]) > 0.98
    assert np.mean([r.predicted == labels[r.doc_id] for r in known]) > 0.95


def test_held_out_labels_and_other_columns_change_nothing(spark, scored):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "text", "'x' lang", "1 x", "0 score")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    labels = labels.selectExpr("doc_id", "CASE WHEN crc32(string(doc_id)) % 5 = 0 THEN 1 - quality ELSE quality END quality")
    got = {r.doc_id: r.score for r in score(docs, labels).collect()}
    assert all(abs(got[r.doc_id] - r.score) < 1e-9 for r in scored)


def test_statistics():
    texts = pa.array(["", None, "Ab é! 1|#", "a a\na a", "w " * 50_000])
    x = text_statistics(texts)
    assert x.shape == (5, 13) and np.isfinite(x).all() and (x[0] == x[1]).all()
    assert np.isclose(x[2][0], np.log1p(9)) and np.isclose(x[2][1], 3 / 9) and np.isclose(x[2][2], 1 / 3)
    assert np.isclose(x[3][8], 1 / 4) and np.isclose(x[3][9], 3 / 4) and np.isclose(x[3][11], 1 / 2)
    assert text_statistics(pa.array([], pa.string())).shape == (0, 13)


def test_odd_rows(spark):
    rows = [(i, f"plain words number {i} and some more words." * (1 + i % 3), 7, "x") for i in range(60)]
    rows += [(100 + i, f"#$%{i}*** !!! ###" * (1 + i % 4), 7, "x") for i in range(15)]
    rows += [(None, None, 7, "x"), (None, "", 7, "x"), (1, "plain words", 7, "x"), (1, "plain words", 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, positive int, quality string")
    marks = [(i, 1) for i in range(0, 60, 2)] + [(100 + i, 0) for i in range(7)] + [(2, 1), (None, 1), (3, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    got = score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert set(range(60)) <= set(ids) and len([i for i in ids if i is not None and i >= 100]) < 8
    assert score(docs.limit(0), labels).count() == 0
    assert {r.score for r in score(docs, labels.limit(0)).collect()} == {0.5}
