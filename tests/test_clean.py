"""Edge cases of the scalar functions (FIXTURES.md §3)."""
from pyspark.sql import functions as F

from sentiscope.functions import clean as C


def one(spark, expr, value, typ="string"):
    df = spark.createDataFrame([(value,)], f"v {typ}")
    return df.select(expr(F.col("v")).alias("o")).first()["o"]


def test_price_parsers(spark):
    assert one(spark, C.price_clean, "₹1,299.00") == 1299.0
    assert one(spark, C.parse_num, "₹1,299.00") == 1.0
    assert one(spark, C.price_clean, "Rs. 1,299") == 0.1299
    assert one(spark, C.parse_num, "Rs. 1,299") == 1.0
    for bad in ["abc", ".", "1.2.3", ""]:
        assert one(spark, C.price_clean, bad) is None


def test_rating_and_packed(spark):
    assert one(spark, C.rating_clean, "4.1 out of 5 stars") == 4.1
    assert one(spark, C.parse_rev_rating, "4.0 out of 5 stars||5 out of 5") == 4.5
    assert one(spark, C.packed_len, None) == 0
    assert one(spark, C.packed_len_filled, None) == 1


def test_category(spark):
    assert one(spark, C.category_of, None) == "Other"
    assert one(spark, C.category_of, "widget") == "Other"
    assert one(spark, C.category_of, " Bar ") == "Smartphone"


def test_label_thresholds(spark):
    assert one(spark, C.sentiment_label, 0.05, "double") == "Positive"
    assert one(spark, C.sentiment_label, -0.05, "double") == "Negative"
    assert one(spark, C.sentiment_label, 0.0499, "double") == "Neutral"


def test_rating_bins_right_closed(spark):
    got = [one(spark, C.rating_bins, v, "double") for v in [0.0, 2.0, 2.5, 3.0, 4.0, 5.0, 5.5]]
    assert got == [0, 0, 1, 1, 2, 3, 1]


def test_half_even(spark):
    assert one(spark, lambda c: C.round_half_even(c, 3), 0.0625, "double") == 0.062
    df = spark.createDataFrame([(1, 8), (49, 400), (3, 0)], "a long, b long")
    got = [r["p"] for r in df.select(C.pct1("a", "b").alias("p")).collect()]
    assert got == [12.5, 12.2, None]


def test_lenient_double_and_displays(spark):
    rows = [("1.5", 4.26, 8.0, 5000.0), ("1d", None, None, None), ("NaN", 4.0, 4.0, 1.0), (" -2e3 ", 5.0, 1.0, 2.0), ("-inf", 1.0, 1.0, 1.0),
            ("", 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "s string, r double, ram double, bat double")
    got = df.select(C.lenient_double("s").alias("x"), C.rating_display("r").alias("r"), C.ram_display("ram").alias("ram"),
                    C.battery_display("bat").alias("bat")).collect()
    assert [g["x"] for g in got] == [1.5, None, None, -2000.0, float("-inf"), None, None]
    assert [g["r"] for g in got[:3]] == ["4.3 / 5", "N/A", "4.0 / 5"]
    assert (got[0]["ram"], got[0]["bat"], got[1]["ram"], got[1]["bat"]) == ("8 GB", "5000 mAh", "N/A", "N/A")
