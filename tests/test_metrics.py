import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from taleloom import tables
from taleloom.functions import vectors as V
from taleloom.operators import metrics as met


def auc(pos, neg):
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


@pytest.fixture(scope="module")
def scored(spark):
    """Coarse scores of four classes, so that many are tied; one class is rare."""
    rng = np.random.default_rng(1)
    y = rng.choice(4, 300, p=[0.5, 0.3, 0.18, 0.02])
    raw = rng.random((300, 4)) + 0.5 * np.eye(4)[y]
    probs = np.round(raw / raw.sum(1, keepdims=True), 1)
    df = pd.DataFrame({"y": y, "probs": [list(p) for p in probs], "pred": probs.argmax(1)})
    return spark.createDataFrame(df, "y int, probs array<double>, pred int").cache(), y, probs


def test_pair_auc_with_ties(scored):
    df, y, probs = scored
    got = {(r.low, r.high): r.auc for r in met.pair_aucs(df, "y", "probs").collect()}
    for a in range(4):
        for b in range(a + 1, 4):
            one = auc(probs[y == a, a], probs[y == b, a])
            two = auc(probs[y == b, b], probs[y == a, b])
            assert got[(a, b)] == pytest.approx((one + two) / 2)


def test_rest_auc(scored):
    df, y, probs = scored
    got = {r["class"]: r.auc for r in met.one_vs_rest_auc(df, "y", "probs").collect()}
    for c in range(4):
        assert got[c] == pytest.approx(auc(probs[y == c, c], probs[y != c, c]))


def test_constant_scores_give_half(spark):
    df = spark.range(40).select((F.col("id") % 2).cast("int").alias("y"), F.array(F.lit(0.5), F.lit(0.5)).alias("p"))
    row = met.one_vs_one_auc(df, "y", "p").first()
    assert row.macro_auc == 0.5 and row.weight_auc == 0.5


def test_unpredicted_class_scores_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (2, 2)], "y int, p int")
    got = {r["class"]: r for r in met.per_class_scores(df, "y", "p").collect()}
    assert got[1].precision == 0 and got[1].recall == 0 and got[1].f1 == 0
    assert got[0].precision == pytest.approx(2 / 3) and got[0].f1 == pytest.approx(0.8)
    macro = met.macro_scores(df, "y", "p").first()
    assert macro.recall == pytest.approx(2 / 3)


def test_matrix_has_zero_cells(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "y int, p int")
    got = {(r.y, r.p): r.n for r in met.confusion_matrix(df, "y", "p").collect()}
    assert got == {(0, 0): 1, (0, 1): 0, (1, 0): 1, (1, 1): 0}


def test_softmax_sums_to_one_and_argmax_takes_the_first(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([800.0, 0.0, -800.0],)], "x array<double>")
    rows = df.select(V.total(V.softmax(F.col("x"))).alias("s"), V.argmax(F.col("x")).alias("a")).collect()
    assert [r.a for r in rows] == [1, 0] and all(r.s == pytest.approx(1) for r in rows)


def test_losses(spark):
    df = spark.createDataFrame([(1, [2.0, 1.0, 0.0])], "anchor_id long, scores array<double>")
    nce = met.contrastive_losses(df, "infoNCE").first().loss
    assert nce == pytest.approx(math.log(sum(map(math.exp, [2, 1, 0]))) - 2)
    masked = met.contrastive_losses(df, "InfoNCE", positives=2).first().loss
    assert masked == pytest.approx(math.log(math.exp(2) + 1) - 2)
    close = spark.createDataFrame([(1, [1.0, 1.0, 2.0])], "anchor_id long, scores array<double>")
    assert met.contrastive_losses(close, "rankloss").first().loss == pytest.approx((0.02 + 1.02) / 2)
    with pytest.raises(ValueError):
        met.contrastive_losses(df, "other")


def test_pooling(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [1, 0]), ([[1.0, 2.0], [3.0, 4.0]], [0, 0])],
                               "tv array<array<double>>, m array<int>")
    got = [r[0] for r in df.select(V.masked_mean(F.col("tv"), F.col("m"), 2)).collect()]
    assert got == [[1.0, 2.0], [0.0, 0.0]]


def test_early_stop_and_best_epochs(spark):
    losses = [5, 4, 3, 3, 3.5, 2, 2.5, 2.5, 2.1, 9]
    df = spark.createDataFrame([("r", i + 1, float(x)) for i, x in enumerate(losses)], "run string, epoch int, v double")
    assert tuple(met.early_stop(df, "v", 3).first()) == ("r", 9, 6)
    assert tuple(met.early_stop(df, "v", 5).first()) == ("r", None, None)
    kept = {r.epoch: (r.is_best, r.is_last) for r in met.best_epochs(df, "v", 2).collect()}
    assert kept == {6: (True, False), 9: (True, False), 10: (False, True)}


def test_perplexity_overflow_is_infinite(spark):
    df = spark.createDataFrame([("a", 1000.0), ("b", 0.0)], "k string, loss double")
    got = {r.k: r.perplexity for r in met.perplexity(df, ["k"], "loss").collect()}
    assert got == {"a": math.inf, "b": 1.0}


def test_attention_weights_sum_to_one(spark, small):
    from taleloom.operators.pooling import attention_pool, attention_weights

    rows = tables.vectors(spark, small)
    sums = attention_weights(rows, "label", "vec_id", "embedding", 64, 4, 1).groupBy("label", "head").agg(F.sum("weight").alias("s"))
    assert all(r.s == pytest.approx(1) for r in sums.collect())
    assert {len(r.emb) for r in attention_pool(rows, "label", "vec_id", "embedding", 64, 4, 1).collect()} == {64}
    with pytest.raises(ValueError):
        attention_pool(rows, "label", "vec_id", "embedding", 64, 3, 1)


def test_nearest_mean_predictions(spark, small):
    df = met.predictions(tables.vectors(spark, small), "vec_id", "embedding", "label")
    assert met.accuracy(df, "label", "pred").first().accuracy > 0.3


def test_attention_with_projections(spark):
    from taleloom.operators.pooling import attention_pool

    rows = [("a", 1, [1.0, 0.0]), ("a", 2, [0.0, 1.0]), ("b", 3, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "code string, id long, v array<double>")
    zero, swap = [[0.0, 0.0], [0.0, 0.0]], [[0.0, 3.0], [1.0, 0.0]]
    got = {r.code: list(r.emb) for r in attention_pool(df, "code", "id", "v", 2, 1, 1, (zero, None, swap)).collect()}
    assert got["a"] == pytest.approx([1.5, 0.5]) and got["b"] == pytest.approx([6.0, 2.0])


def test_auc_tells_tiny_scores_apart(spark):
    rows = [("k", 3e-7, 0), ("k", 2.9e-7, 0), ("k", 4.1e-7, 1), ("k", 4.2e-7, 1)]
    rows += [("t", 1.0, i % 2) for i in range(10)] + [("r", 1 - i * 1e-12, int(i > 50)) for i in range(101)]
    df = spark.createDataFrame(rows, "key string, score double, is_pos int")
    got = {r.key: (r.auc, r.n_pos, r.n_neg) for r in met.rank_auc(df, ["key"]).collect()}
    assert got == {"k": (1.0, 2, 2), "t": (0.5, 5, 5), "r": (0.0, 50, 51)}


def test_bundle_by_run_and_phase_with_totals(spark):
    import random

    draw = random.Random(4)
    rows = []
    for i in range(240):
        probs = [draw.random() for _ in range(3)]
        rows.append((f"r{i % 2}", "train" if i % 3 else "test", i % 3 if draw.random() < 0.6 else (i + 1) % 3, probs))
    df = spark.createDataFrame(rows, "run string, phase string, target int, probs array<double>")
    df = df.withColumn("pred", F.expr("cast(array_position(probs, array_max(probs)) - 1 as int)")).withColumn("truth", F.col("target"))
    got = {(r.run, r.phase): r for r in met.metric_bundle(df, "truth", "pred", "target", "probs", ["run", "phase"]).collect()}
    runs, phases = ["r0", "r1"], ["train", "test"]
    assert set(got) == {(r, p) for r in runs for p in phases} | {(r, None) for r in runs} | {(None, None)}
    for run, phase in got:
        part = df.filter((F.lit(run is None) | (F.col("run") == run)) & (F.lit(phase is None) | (F.col("phase") == phase)))
        one = met.macro_scores(part, "truth", "pred").first().asDict() | met.one_vs_one_auc(part, "target", "probs").first().asDict()
        one["accuracy"] = met.accuracy(part, "truth", "pred").first().accuracy
        assert all(abs(one[name] - got[run, phase][name]) < 1e-12 for name in one)
    plain = met.metric_bundle(df, "truth", "pred", "target", "probs").collect()
    assert len(plain) == 1 and abs(plain[0].accuracy - got[None, None].accuracy) < 1e-12
