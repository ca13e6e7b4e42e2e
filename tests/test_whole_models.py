"""Models are trained on all words, with the defaults of the operator."""

import pytest
from pyspark.sql import functions as F

from taleloom.operators import models
from taleloom.operators.topics import topics
from taleloom.plans import QUERIES


@pytest.mark.parametrize("name, size", [("t7_word_vectors", 64), ("t7_word_vectors_whole", 768)])
def test_queries_train_all_rounds(spark, small, monkeypatch, name, size):
    asked = []

    class Stop(Exception):
        pass

    def word2vec(**how):
        asked.append((how["vectorSize"], how["maxIter"]))
        raise Stop

    monkeypatch.setattr(models, "Word2Vec", word2vec)
    with pytest.raises(Stop):
        QUERIES[name](spark, small)
    assert asked == [(size, 40)]


def test_topics_take_every_word(spark):
    n = 270_000  # more than 2 ** 18, each in one text
    words = F.transform(F.sequence(F.col("id") * 1000, F.col("id") * 1000 + 999), lambda i: F.concat(F.lit("w"), i.cast("string")))
    df = spark.range(n // 1000).select(words.alias("words"))
    found = topics(df, F.col("words"), k=2, top=n, rounds=1)
    assert found.filter("topic = 0").select("word").distinct().count() == n
