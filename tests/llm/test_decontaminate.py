"""Decontamination against a plain scan, and its two ways of lookup against each other."""

import re

import pytest

from taleloom.llm.decontaminate import cut_spans, drop_contaminated, find_hits
from pyspark.sql import functions as F

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, n=13):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add("null" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                named = windows.get(tuple(w[i : i + size]))
                if named:
                    hit.update(range(i, i + size))
                    found |= named
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


ITEM = "One two, three FOUR five six seven eight nine ten eleven twelve thirteen fourteen."
DOCS = [
    (1, "before " + ITEM + " after"),
    (2, "one two three four five six seven eight nine ten eleven twelve"),
    (3, None),
    (4, ""),
    (None, "é short item here É"),
    (5, "word " * 30000 + ITEM),
    (5, "word " * 30000 + ITEM),
    (6, "x1 short\nITEM y two three four five six seven eight nine ten eleven twelve thirteen fourteen x"),
    (7, "shortitem short"),
]
ITEMS = [(10, ITEM), (11, "short item"), (11, "short item"), (None, "É"), (12, None), (13, "...")]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(d, t, "x", 0) for d, t in DOCS], "doc_id long, text string, n_hit string, hash int")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_same_as_plain_scan(tables, bound):
    docs, items = tables
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in find_hits(docs, items, bound=bound).collect()]
    assert sorted(got, key=str) == plain(DOCS, ITEMS)


def test_real_documents_both_ways(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    want = plain([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    assert any(n for _, _, n, _ in want)
    for bound in (1 << 20, 0):
        got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in find_hits(docs, items, bound=bound).collect()]
        assert sorted(got, key=str) == want


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_documents_are_dropped_whole(tables, bound):
    docs, items = tables
    kept = drop_contaminated(docs, items, bound=bound)
    assert kept.columns == docs.columns
    # 5 has the item among 30,000 other words, 7 no whole-word hit.
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 3, 4, 5, 5, 7]


def test_spans_are_cut(tables):
    docs, items = tables
    rows = find_hits(docs, items).join(docs.filter("doc_id in (1, 7)").select("doc_id", "text"), "doc_id")
    cut = {r.doc_id: r.cut for r in rows.select("doc_id", cut_spans(F.col("text"), F.col("spans")).alias("cut")).collect()}
    assert cut == {1: "before . after", 7: "shortitem short"}


def test_empty_tables(tables):
    docs, items = tables
    assert find_hits(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in find_hits(docs, items.limit(0)).collect()} == {0}
    assert find_hits(docs, items.limit(0), bound=-1).count() == len(DOCS)
