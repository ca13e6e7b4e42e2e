import pytest
from pyspark.sql import functions as F

from taleloom import tables
from taleloom.operators import ranking, relational
from taleloom.operators import sampling as smp


@pytest.fixture(scope="module")
def skewed(spark):
    """3000 rows, a third of them in one class, one class with a single row."""
    label = F.when(F.col("id") == 0, 99).when(F.col("id") % 3 == 0, 0).otherwise(1 + F.col("id") % 5)
    return spark.range(3000).select("id", label.cast("int").alias("label"))


def test_positions_are_a_permutation(skewed):
    out = ranking.shuffled_positions(skewed, "id", 1, ["label"]).collect()
    by_label = {}
    for row in out:
        by_label.setdefault(row.label, []).append(row.pos)
    assert len(out) == 3000
    assert all(sorted(p) == list(range(len(p))) for p in by_label.values())


def test_positions_do_not_depend_on_partitions(skewed):
    one = ranking.shuffled_positions(skewed.repartition(13), "id", 1).collect()
    two = ranking.shuffled_positions(skewed.coalesce(1), "id", 1).collect()
    assert {r.id: r.pos for r in one} == {r.id: r.pos for r in two}


def test_id_positions_over_many_buckets(spark):
    ids = spark.range(5).select((F.col("id") * 40000 + 7).alias("id"))
    out = {r.id: r.pos for r in ranking.id_positions(ids, "id").collect()}
    assert out == {7: 0, 40007: 1, 80007: 2, 120007: 3, 160007: 4}


def test_stratified_split(skewed):
    out = smp.stratified_split(skewed, "label", "id", "80_10_10", 3).collect()
    assert len(out) == len({r.id for r in out}) == 3000
    counts = {}
    for r in out:
        counts.setdefault(r.label, {}).setdefault(r.split, 0)
        counts[r.label][r.split] += 1
    for label, c in counts.items():
        n = sum(c.values())
        for split, share in (("train", 0.8), ("val", 0.1), ("test", 0.1)):
            assert abs(c.get(split, 0) - share * n) <= 1


def test_split_without_test_part(skewed):
    out = smp.stratified_split(skewed, "label", "id", "80_20_0", 3)
    assert {r.split for r in out.select("split").distinct().collect()} == {"train", "val"}


@pytest.mark.parametrize("spec", ["80_20_10", "50_20_0", "110_-5_-5"])
def test_split_spec_must_sum_to_100(spec):
    with pytest.raises(ValueError):
        smp.parse_split_spec(spec)


def test_pair_samples(skewed):
    out = smp.pair_samples(skewed, "label", "id", 2, 5, 5).collect()
    by_anchor = {}
    for r in out:
        by_anchor.setdefault(r.anchor_id, []).append(r)
    for anchor, rows in by_anchor.items():
        drawn = [r.sample_id for r in rows]
        assert anchor not in drawn and len(set(drawn)) == len(drawn)
        for r in rows:
            assert (r.sample_label == r.anchor_label) == (r.kind == "positive")
    assert sum(r.kind == "positive" for r in by_anchor[0]) == 0
    assert all(len(rows) == 7 for anchor, rows in by_anchor.items() if anchor != 0)


def test_single_class_has_no_negatives(spark):
    one = spark.range(6).select("id", F.lit(1).alias("label"))
    out = smp.pair_samples(one, "label", "id", 2, 5, 5).collect()
    assert {r.kind for r in out} == {"positive"} and len(out) == 12


def test_small_classes(skewed):
    assert [tuple(r) for r in smp.small_classes(skewed, "label", 2).collect()] == [(99, 1, 2)]


def test_class_samples(skewed):
    out = smp.class_samples(skewed, "label", "id", 5).collect()
    by_anchor = {}
    for r in out:
        by_anchor.setdefault(r.anchor_id, {})[r.slot] = r
    assert all(len(slots) == 7 for a, slots in by_anchor.items() if a != 0)
    for anchor, slots in by_anchor.items():
        assert len({r.sample_label for r in slots.values()}) == len(slots)
        if anchor != 0:
            assert slots[1].sample_label == slots[1].anchor_label and slots[1].sample_id != anchor
    assert 1 not in by_anchor[0]


def test_packed_rows(skewed):
    packed = smp.packed(smp.pair_samples(skewed, "label", "id", 2, 5, 5)).collect()
    for row in packed:
        assert row["items"][0].id == row.anchor_id
        assert [i.slot for i in row["items"]] == sorted(i.slot for i in row["items"])
        assert row.anchor_id == 0 or len(row["items"]) == 1 + 2 + 5


def test_batches(spark, skewed):
    split = smp.hash_split(skewed, "id", 0.3, 1)
    out = smp.batch_numbers(split, "split", "id", 64, 1).groupBy("split", "batch").count().collect()
    for name in ("train", "test"):
        sizes = [r["count"] for r in sorted((r for r in out if r.split == name), key=lambda r: r.batch)]
        assert all(s == 64 for s in sizes[:-1]) and 0 < sizes[-1] <= 64


def test_long_texts_are_not_augmented(spark):
    df = spark.createDataFrame([(1, "A" * 5000, "train"), (2, "A" * 10, "train"), (3, "A", "val")], "id long, t string, split string")
    out = {r.id: r.t for r in smp.augment_training_rows(df, "t", "split", "id", 1.0, 1, F.lower).collect()}
    assert out == {1: "A" * 5000, 2: "a" * 10, 3: "A"}


def test_masking_share(spark, small):
    from taleloom.functions.text import tokens

    rows = tables.load(spark, small, "documents").select("doc_id", tokens(F.col("text")).alias("w"))
    out = smp.mask_tokens(rows, "w", "doc_id", 1)
    n, hidden, kept = out.select(
        F.sum(F.size("w")), F.sum(F.size(F.filter("targets", lambda t: t.isNotNull()))),
        F.sum(F.size(F.filter("masked", lambda t: t != "[MASK]"))),
    ).first()
    assert 0.12 < hidden / n < 0.18 and hidden + kept == n


def test_attach_keeps_row_count(spark):
    stories = spark.createDataFrame([(1, "1", None, "x"), (2, "1", None, "x"), (3, "2", "d", "y")], "id long, a string, d string, t string")
    computed = spark.createDataFrame([(9, "1", None, "x", [1.0]), (8, "1", None, "x", [2.0]), (7, "2", "d", "y", [3.0])],
                                     "cid long, a string, d string, t string, v array<double>")
    out = relational.attach_vectors(stories, computed, ["a", "d", "t"], "v", "cid").select("id", "v").collect()
    assert sorted((r.id, r.v[0]) for r in out) == [(1, 2.0), (2, 2.0), (3, 3.0)]
    report = relational.attach_report(stories, computed, ["a", "d", "t"]).first()
    assert tuple(report) == (3, 3, 1)


def test_natural_join_matches_null_keys(spark):
    a = spark.createDataFrame([(1, None, "p")], "k long, t string, x string")
    b = spark.createDataFrame([(1, None, "q")], "k long, t string, y string")
    assert [tuple(r) for r in relational.natural_join(a, b).collect()] == [(1, None, "p", "q")]


def test_negatives_are_spread_over_classes(spark):
    df = spark.range(500).selectExpr("id", "int(id % 10) label")
    rows = smp.pair_samples(df, "label", "id", 2, 5, seed=5).filter("kind = 'negative'").collect()
    seen = {}
    for r in rows:
        seen.setdefault(r.anchor_id, []).append((r.sample_id, r.sample_label, r.anchor_label))
    assert all(len({x[0] for x in v}) == 5 and all(x[1] != x[2] for x in v) for v in seen.values())
    assert sum(len({x[1] for x in v}) >= 4 for v in seen.values()) > 0.9 * len(seen) == 450
