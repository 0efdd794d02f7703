from pyspark.sql import functions as F

from lakelens.functions import scalars as X


def test_next_month(spark):
    df = spark.createDataFrame([("9912",), ("2607",), ("0909",), ("2612",)], "m string")
    assert [r.n for r in df.select(X.next_month(F.col("m")).alias("n")).collect()] == ["10001", "2608", "0910", "2701"]


def test_words(spark):
    df = spark.createDataFrame([("  a \t b\n\nc ",), ("",), (None,)], "t string")
    got = df.select(X.collapse(F.col("t")).alias("c"), X.cap_words(F.col("t"), 2).alias("h")).collect()
    assert [tuple(r) for r in got] == [("a b c", "a b"), ("", ""), (None, None)]


def test_overlaps(spark):
    df = spark.createDataFrame([(1, 1), (2, 3), (5, 9)], "a int, z int")
    count = lambda x, y: df.filter(X.overlaps(F.col("a"), F.col("z"), x, y)).count()
    assert [count(2, 4), count(None, None), count(3, None), count(None, 1)] == [1, 3, 2, 1]


def test_fusion_and_gain(spark):
    r = spark.range(1, 2).select(X.reciprocal_rank(F.col("id")).alias("f"), X.gain(F.col("id") + 2).alias("g")).first()
    assert abs(r.f - 1 / 61) < 1e-12 and abs(r.g - 0.5) < 1e-12
