"""The rule cascade: features by brute force, order by measured cost, verdicts that no order changes."""

import re
from collections import Counter

import numpy as np
import pytest

from taleloom.llm import rules
from taleloom.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    repeat = len(inside)
    return (n, sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat,
            n < 50 or 100 * repeat > 50 * n)


def test_query_on_whole_texts(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = QUERIES["op11_quality_rules"](spark, small).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(docs[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_good_texts_stay(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op11_quality_rules"](spark, d).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    judged = [i for i in labels if not got[i].base_failed]
    assert all(got[i].kept for i in judged if labels[i])
    assert np.mean([got[i].kept for i in judged if not labels[i]]) < 0.1


ODD = [None, "", " \n\t ", "a b c a b c\n\na b c a b c\n x", "é ü ß " * 60, "A#B " * 70, "w " * 30_000, "one two " * 30]


def test_odd_rows(spark):
    rows = [(i, t, "n", True) for i, t in enumerate(ODD)] + [(None, ODD[3], "n", None), (3, ODD[3], "n", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept boolean")
    got = rules.judge(docs).collect()
    assert len(got) == len(rows)
    by_id = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert by_id == Counter((r[0], *brute(r[1])) for r in rows)
    assert rules.judge(docs.limit(0)).count() == 0
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns
    verdicts = {(r.doc_id, r.n_words): r.kept for r in got}
    assert {r.doc_id for r in kept.collect()} == {i for (i, _), k in verdicts.items() if k}


def test_any_order_gives_the_same_verdicts():
    texts = [(t or "").encode() for t in ODD] + [b"plain words of a text " * 3 + str(i).encode() for i in range(9)]
    both = [*rules.BASE, *rules.MORE]
    forward = [any(rules.Row(t, rules.FEATURES).breaks(r) for r in both) for t in texts]
    backward = [any(rules.Row(t, rules.FEATURES).breaks(r) for r in reversed(both)) for t in texts]
    assert forward == backward


def test_order_is_rejections_per_cost_among_survivors():
    features = {n: rules.Feature((), lambda t: 0) for n in "abc"}
    made = [rules.Rule(n, (n,), lambda v: False) for n in "abc"]
    times = np.tile([1.0, 1.0, 10.0], (100, 1))
    verdicts = np.zeros((100, 3), bool)
    verdicts[:50, 0] = True  # half the rows
    verdicts[10:50, 1] = True  # nothing that a leaves
    verdicts[40:100, 2] = True  # most rows, but ten times the cost
    order = [r.name for r in rules.ordered(made, times, verdicts, features)]
    assert order == ["a", "c", "b"]
    assert [r.name for r in rules.ordered(made, times, verdicts, features, given=["c"])] == ["c", "a", "b"]


def test_short_circuit_computes_nothing_more():
    asked = []
    features = {n: rules.Feature((), lambda t, n=n: asked.append(n) or 1) for n in "ab"}
    row = rules.Row(b"x", features)
    order = [rules.Rule("a", ("a",), lambda v: True), rules.Rule("b", ("b",), lambda v: True)]
    assert any(row.breaks(r) for r in order) and asked == ["a"]


@pytest.mark.parametrize("sample", [1, 10_000])
def test_plan_reads_a_bounded_sample(spark, small, sample):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    order = rules.plan_cascade(docs, [*rules.BASE, *rules.MORE], sample=sample)
    assert {r.name for r in order} == {r.name for r in [*rules.BASE, *rules.MORE]}
