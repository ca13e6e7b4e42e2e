import pytest
from pyspark.sql import functions as F

from taleloom.operators import skew


@pytest.fixture(scope="module")
def rows(spark):
    """6000 rows: a third with one key, some without a key, the rest spread thinly."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, None).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 2500).cast("string"))
    )
    return spark.range(6000).select("id", key.alias("key"))


def test_hot_keys_are_few_and_cut_evenly(rows):
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = skew.hot_keys(sizes, "key", "n", parts=50)
    assert [tuple(r) for r in hot.collect()] == [("hot", 17)]
    pieces = skew.cut(rows, hot, "key", "id").groupBy("key", "_piece").count()
    assert pieces.agg(F.max("count")).first()[0] < 2 * 6000 / 50


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_same_rows_as_a_plain_join(rows, how):
    lookup = rows.filter("key is not null and key not like 'k1%'").select("key").distinct().withColumn("v", F.length("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = skew.hot_keys(sizes, "key", "n", parts=50)
    pieces = skew.repeated(lookup, hot, "key")
    ours = skew.cut(rows, hot, "key", "id").join(pieces, ["key", "_piece"], how).drop("_piece")
    plain = rows.join(lookup, "key", how)
    assert sorted(ours.columns) == sorted(plain.columns)
    cols = sorted(plain.columns)
    assert sorted(map(str, ours.select(cols).collect())) == sorted(map(str, plain.select(cols).collect()))
