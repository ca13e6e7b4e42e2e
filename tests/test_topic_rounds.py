"""Rounds of topics read their own texts only; a block's texts go through in runs without a change."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from taleloom import session
from taleloom.operators import topics as tp


def test_a_round_reads_its_own_texts(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(tp, "cut_lineage", lambda *how, **by: stored.append(session.cut_lineage(*how, **by)) or stored[-1])
    df = spark.createDataFrame([([f"w{i}", "x"],) for i in range(40)], "words array<string>")
    assert tp.topics(df, F.col("words"), k=2, top=50, rounds=4).filter("topic = 0").count() == 41
    bags = stored[0]
    for turn in {r["round"] for r in bags.select("round").distinct().collect()}:
        one = bags.filter(F.col("round") == turn)
        assert "PartitionFilters: [isnotnull(round" in one._jdf.queryExecution().executedPlan().toString()
        files = {r[0] for r in one.select(F.input_file_name()).distinct().collect()}
        assert files and all(f"/round={turn}/" in f for f in files)


@pytest.mark.parametrize("entries", [1, 7, 10_000])
def test_runs_of_texts_change_nothing(monkeypatch, entries):
    rng = np.random.default_rng(4)
    entry = np.unique(rng.integers(0, 40 * 30, 500))
    text, word = np.divmod(entry, 30)
    text = text + (text > 5)  # text 6 is empty
    n = rng.integers(1, 4, len(text)).astype("f8")
    weights = rng.uniform(0.5, 2, (30, 3))
    how = (text, word, n, 41, weights, weights.sum(axis=0), 0.3)
    want = tp.fit_block(*how)
    monkeypatch.setattr(tp, "RUN_ENTRIES", entries)
    assert np.allclose(tp.fit_block(*how), want, atol=1e-9) and np.allclose(want.sum(), n.sum())
    empty = np.zeros(0, "i8")
    assert not tp.fit_block(empty, empty, np.zeros(0), 2, weights, weights.sum(axis=0), 0.3).any()
