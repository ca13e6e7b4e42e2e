from pyspark.sql import functions as F

from taleloom.functions import codes, text
from taleloom.operators import catalogue as cat


def one(df):
    return [r[0] for r in df.collect()]


def test_category_edges(spark):
    rows = [(" 12 ",), ("",), (None,), ("0510A*",), ("1,2",), ("123456",), ("1170",), ("2400",), ("0",), ("1_0",),
            ("+5",), ("299",), ("300",), ("00750",), ("2399",), ("99999999999999",)]
    df = spark.createDataFrame(rows, "atu string")
    got = one(df.select(codes.category(F.col("atu"))))
    none = codes.NOT_FOUND
    assert got == ["Animal Tales", none, none, none, none, none, none, none, none, none, none, "Animal Tales",
                   "Tales of Magic", "Religious Tales", "Formula Tales", none]


def test_trim_code(spark):
    df = spark.createDataFrame([("0510A*",), ("00*",), ("*",), ("12**",)], "atu string")
    assert one(df.select(codes.trim_code(F.col("atu")))) == ["510A", "0", "", "12*"]


def test_known_category_keeps_null(spark):
    df = spark.createDataFrame([("a",), (None,), ("NOT FOUND",)], "category string")
    assert one(cat.known_category(df)) == ["a", None]


def test_last_description_wins_even_when_null(spark):
    df = spark.createDataFrame([("1", "x", 1), ("1", None, 2), ("2", "y", 3)], "c string, d string, i long")
    got = dict(tuple(r) for r in cat.code_descriptions(df, "c", "d", "i").collect())
    assert got == {"1": None, "2": "y"}


def test_display_key_is_null_with_null_part(spark):
    df = spark.createDataFrame([("1", None), ("2", "b")], "a string, d string")
    assert one(df.select(codes.display_key(F.col("a"), F.col("d")))) == [None, "2(b)"]


def test_split_heading(spark):
    df = spark.createDataFrame([("275A The race of",), ("alone",)], "h string")
    atu, desc = codes.split_heading(F.col("h"))
    assert [tuple(r) for r in df.select(atu, desc).collect()] == [("275A", "The race of"), ("alone", None)]


def test_text_functions(spark):
    df = spark.createDataFrame([(" The  Fox, the CROW!\nRan. Away? ",)], "t string")
    row = df.select(
        text.tokens(F.col("t")).alias("w"), text.sentences(F.col("t")).alias("s"), text.clean_text(F.col("t")).alias("c")
    ).first()
    assert row.w == ["the", "fox,", "the", "crow!", "ran.", "away?"]
    assert row.s == ["The  Fox, the CROW!", "Ran.", "Away?"]
    assert row.c == "fox crow ran away"


def test_labels_round_trip(spark):
    names = [name for _, _, name in codes.CATEGORY_RANGES] + ["NOT FOUND"]
    df = spark.createDataFrame([(n,) for n in names], "category string")
    labels = cat.label_dimension(df)
    got = {r.category: r.label_id for r in cat.encode_labels(df, labels).collect()}
    assert got["TALES OF THE STUPID OGRE (GIANT, DEVIL)"] == 5
    assert got["Tales of Magic"] == 6
    assert got["NOT FOUND"] is None


def test_promoted_books(spark):
    paths = [("a/x.txt",), ("nest/b/y.txt",), ("nest/c/z.txt",), ("drop/q.txt",)]
    out = cat.promote_book(spark.createDataFrame(paths, "path string"), "nest", ["drop"])
    assert sorted(tuple(r) for r in out.collect()) == [
        ("a", "x.txt", "a/x.txt"), ("b", "y.txt", "nest/b/y.txt"), ("c", "z.txt", "nest/c/z.txt")]
