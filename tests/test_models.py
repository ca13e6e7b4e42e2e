import pytest
from pyspark.sql import functions as F

from taleloom import tables
from taleloom.operators import features, models
from taleloom.operators import sampling as smp
from taleloom.plans import QUERIES


@pytest.fixture(scope="module")
def rows(spark, small):
    data = models.as_features(tables.load(spark, small, "embeddings"), "vec_id", "embedding", "label")
    return smp.hash_split(data, "vec_id", 0.1, 42).cache()


@pytest.mark.parametrize("make", [models.decision_tree, models.random_forest, lambda: models.perceptron(64, 10, 25)])
def test_model_predicts_known_labels(rows, make):
    out = models.predicted(rows, make()).select("prediction").distinct().collect()
    assert {r.prediction for r in out} <= set(range(10))


def test_svm_beats_chance_on_its_training_rows(rows):
    both = rows.withColumn("split", F.lit("train"))
    fitted = models.linear_svm(both.count(), c=1.0).fit(both)
    hits = fitted.transform(both).select(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    assert hits > 0.3


def test_svm_is_fitted_in_tasks_of_many_rows(spark, rows, monkeypatch):
    """Each of a fit's jobs has a task per partition, so rows from many files are put together, and all are used."""
    both = rows.withColumn("split", F.lit("train")).repartition(50)
    n, seen, fit = both.count(), [], models.LinearSVC.fit

    def watched(self, dataset, params=None):
        seen.append((dataset.rdd.getNumPartitions(), dataset.count()))
        return fit(self, dataset, params)

    monkeypatch.setattr(models.LinearSVC, "fit", watched)
    monkeypatch.setattr(models, "TASK_ROWS", -(-n // 3))
    out = models.predicted(both.unionByName(both.withColumn("split", F.lit("test"))), models.linear_svm(n, max_iter=2))
    assert out.count() == n and set(seen) == {(3, n)}


def test_compared_models(rows):
    out = models.compared(rows, {"tree": models.decision_tree(), "forest": models.random_forest()}, "vec_id").collect()
    assert {r.model for r in out} == {"tree", "forest"} and all(0 <= r.accuracy <= 1 for r in out)


def test_topics_and_projection(spark, small):
    topics = QUERIES["t8_topics"](spark, small).collect()
    assert len(topics) == 70 and all(r.word for r in topics)
    points = QUERIES["t12_projection"](spark, small).collect()
    assert {len(r.point) for r in points} == {2}


def test_word_vectors(spark, small):
    out = QUERIES["t7_word_vectors"](spark, small)
    assert out.count() == 200 and len(out.first().embedding) == 64


def test_grid_search_orders_by_accuracy(spark, small):
    scores = [r.accuracy for r in QUERIES["m7_grid_search"](spark, small).collect()]
    assert len(scores) == 4 and scores == sorted(scores, reverse=True)


def test_random_search_is_seeded(spark, small):
    rows = [tuple(r) for r in QUERIES["m7_random_search"](spark, small).collect()]
    assert len(rows) == 20 and all(1e-4 <= r[0] <= 1 and 0 <= r[1] <= 1 for r in rows)
    assert [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)


def test_nearest_vote_is_compared(spark, small):
    assert {r.model for r in QUERIES["m6_compared_models"](spark, small).collect()} >= {"nearest_3", "linear_svm"}


def test_user_encoder_is_loaded_per_task(spark):
    df = spark.range(7).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))

    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    assert {tuple(r.embedding) for r in features.encode_with(df, "id", "text", load).collect()} == {(2.0, 1.0)}


def test_hashed_vectors_have_length_one(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, " "), (3, None)], "id long, text string")
    got = {r.id: sum(x * x for x in r.embedding) for r in features.encode_hashed(df, ["id"], "text", 16).collect()}
    assert got[1] == pytest.approx(1) and got[2] == 0 and got[3] == 0


def test_method_names(spark, small):
    docs = tables.load(spark, small, "documents")
    with pytest.raises(ValueError):
        features.book_vectors(docs, "source", "doc_id", "text", 8, method="other")


def test_hashed_batches_stay_in_arrow(spark, monkeypatch):
    """A batch is no column of Python strings; lists of sentences, empty and null ones included, are read as before."""
    monkeypatch.setattr(F, "pandas_udf", None)
    df = spark.createDataFrame([(1, ["a b", "c"]), (2, []), (3, None), (4, ["a b"])], "id long, parts array<string>")
    plan = df.select("id", features.hashed_mean(F.col("parts"), 8).alias("v"))
    got = {r.id: r.v for r in plan.collect()}
    assert got[2] == got[3] == [0.0] * 8 and sum(x * x for x in got[4]) == pytest.approx(1) and len(got[1]) == 8
