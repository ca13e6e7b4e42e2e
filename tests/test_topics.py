"""Topics: planted ones are found, blocks and rounds change little, odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taleloom.operators import topics as tp


def planted(n=120, k=3, words=8):
    draw = random.Random(3)
    return [([f"t{i % k}w{draw.randrange(words)}" for _ in range(30)],) for i in range(n)]


@pytest.mark.parametrize("block_words, rounds", [(400_000, 6), (200, 6)])
def test_planted_topics_are_found(spark, block_words, rounds):
    df = spark.createDataFrame(planted(), "words array<string>").coalesce(1)
    rows = tp.topics(df, F.col("words"), k=3, top=5, rounds=rounds, seed=1, block_words=block_words).collect()
    assert len(rows) == 15 and {r.place for r in rows} == set(range(5))
    names = [{r.word[:2] for r in rows if r.topic == t} for t in range(3)]
    assert all(len(s) == 1 for s in names) and len(set.union(*names)) == 3


def test_weights_are_shares_of_the_topic(spark):
    df = spark.createDataFrame(planted(40), "words array<string>")
    rows = tp.topics(df, F.col("words"), k=3, top=1000, rounds=4).groupBy("topic").agg(F.sum("weight").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in rows) and len(rows) == 3


def test_tables_are_merged_without_a_change(spark, monkeypatch):
    df = spark.createDataFrame(planted(60), "words array<string>").coalesce(1)
    def run():
        return {(r.topic, r.word): r.weight for r in tp.topics(df, F.col("words"), k=3, top=99, rounds=5).collect()}
    plain = run()
    monkeypatch.setattr(tp, "MERGE_AFTER", 1)
    merged = run()
    assert plain.keys() == merged.keys() and all(abs(plain[x] - merged[x]) < 1e-12 for x in plain)


def test_earlier_sums_are_read_where_they_are(spark):
    """Joining the words of a round to all earlier tables shuffles these words once, and no table."""
    sums = [{"a": 1.0, "b": 2.0, "c": 4.0}, {"b": 8.0}, {"c": 16.0, "d": 32.0}]
    tables = [tp._bucketed(spark.createDataFrame([(w, x, -x) for w, x in t.items()], "word string, m0 double, m1 double"), 8)[0] for t in sums]
    needed = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (2, "x")], "block long, word string")
    df = tp._with_sums(needed, tables, ["m0", "m1"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    want = {(b, w): sum(t.get(w, 0.0) for t in sums) for b, w in needed.collect()}
    assert {(r.block, r.word): (r.m0, r.m1) for r in df.collect()} == {k: (x, -x) for k, x in want.items()}


def test_one_text_block_as_by_hand():
    rng = np.random.default_rng(1)
    weights, totals, alpha = rng.uniform(0.5, 2, (4, 2)), np.array([40.0, 50.0]), 0.5
    text, word, n = np.array([0, 0, 1, 1, 1]), np.array([0, 1, 1, 2, 3]), np.array([2.0, 1, 1, 3, 1])
    got = tp.fit_block(text, word, n, 3, weights, totals, alpha)  # text 2 is empty
    beta = np.exp(tp.digamma(weights) - tp.digamma(totals))
    want = np.zeros((4, 2))
    for d in (0, 1):
        gamma = np.ones(2)
        for _ in range(500):
            theta = np.exp(tp.digamma(gamma) - tp.digamma(gamma.sum()))
            phi = {w: theta * beta[w] / (theta * beta[w]).sum() for w in word[text == d]}
            gamma = alpha + sum(c * phi[w] for w, c in zip(word[text == d], n[text == d]))
        for w, c in zip(word[text == d], n[text == d]):
            want[w] += c * phi[w]
    assert np.allclose(got, want, atol=0.02) and np.allclose(got.sum(), n.sum())


def test_digamma():
    assert np.allclose(tp.digamma(np.array([0.1, 1.0, 3.5, 50.0])), [-10.4237549404, -0.5772156649, 1.1031566406, 3.9019896734])


def test_odd_inputs(spark):
    rows = [(None,), ([],), (["a", None, "b"],), (["a"],)]
    df = spark.createDataFrame(rows, "words array<string>")
    got = tp.topics(df, F.filter("words", lambda w: w.isNotNull()), k=2, rounds=3).collect()
    assert {r.word for r in got} == {"a", "b"}
    assert tp.topics(df.limit(0), F.col("words"), k=2, rounds=3).collect() == []
