"""Stand-in raw product rows built from the driver's test tables.

This only reshapes ``part``, ``documents`` and ``labels`` into the raw
product-file schema (every column a string, reviews packed with a double
pipe). It does none of the library's work: cleaning, flattening and scoring
run on its output through the library's own operators.

Rules (see FIXTURES.md §2); the DuckDB form lives in ``plans/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: p_type's first word -> raw form_factor text ---
TYPE_TO_FORM_FACTOR = {
    "ECONOMY": " Bar ",
    "LARGE": "flat panel monitor",
    "MEDIUM": "LAPTOP",
    "PROMO": "in-ear",
    "SMALL": "smartwatch",
}
OTHER_FORM_FACTOR = "widget"

REVIEWS_PER_PRODUCT = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed_reviews(spark: SparkSession, sf_dir: str, short_lists: bool = False) -> DataFrame:
    """(product_id, reviews, reviews_rating): five documents per product, packed.

    Groups hold at most five documents by construction (doc_id / 5), so the
    per-group array is bounded. Documents and labels are both dealt out by
    product and meet within it, so that texts are shuffled once.
    """
    product = F.floor(F.col("doc_id") / REVIEWS_PER_PRODUCT).alias("product_id")
    star = (F.when(F.col("quality") == 1, F.lit("5.0 out of 5 stars"))
            .when(F.col("quality") == 0, F.lit("2.0 out of 5 stars"))
            .otherwise(F.lit("")))
    docs = (table(spark, sf_dir, "documents")
            .select(product, F.struct("doc_id", F.regexp_replace("text", r"[|]+", " ").alias("text")).alias("doc"))
            .groupBy("product_id").agg(F.collect_list("doc").alias("docs")))
    marks = (table(spark, sf_dir, "labels").where(F.col("doc_id").isNotNull())
             .select(product, F.struct("doc_id", star.alias("star")).alias("mark"))
             .groupBy("product_id").agg(F.collect_list("mark").alias("marks")))

    def rated(d):
        """A document once for each of its labels, or with an empty star text."""
        own = F.transform(F.filter("marks", lambda m: m["doc_id"] == d["doc_id"]), lambda m: m["star"])
        stars = F.when(F.size(own) > 0, own).otherwise(F.array(F.lit("")))
        return F.transform(stars, lambda x: F.struct(d["doc_id"].alias("doc_id"), d["text"].alias("text"), x.alias("star")))

    grouped = docs.join(marks, "product_id", "left").select(
        "product_id", F.array_sort(F.flatten(F.transform("docs", rated))).alias("items"))
    texts = F.transform("items", lambda x: x["text"])
    stars = F.transform("items", lambda x: x["star"])
    if short_lists:  # every 7th product lacks its last star text (exercises the list-zip truncation)
        stars = F.when(F.col("product_id") % 7 == 0,
                       F.slice(stars, 1, F.size(stars) - 1)).otherwise(stars)
    return grouped.select("product_id",
                          F.concat_ws("||", texts).alias("reviews"),
                          F.concat_ws("||", stars).alias("reviews_rating"))


def raw_products(spark: SparkSession, sf_dir: str, short_lists: bool = False) -> DataFrame:
    """Raw product rows (all strings except the row id) from ``part`` + packed reviews."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    size = F.col("p_size")
    ptype = F.split(F.col("p_type"), " ").getItem(0)
    ff = F.lit(OTHER_FORM_FACTOR)
    for t, v in reversed(list(TYPE_TO_FORM_FACTOR.items())):
        ff = F.when(ptype == t, F.lit(v)).otherwise(ff)
    s = lambda c: c.cast("string")
    price = F.concat(F.lit("₹"), s(size), F.lit(","),
                     F.lpad(s(F.floor("p_retailprice").cast("long")), 3, "0"), F.lit(".50"))
    rating = F.concat(s(1 + size % 5), F.lit("."), s(key % 10), F.lit(" out of 5 stars"))
    prod = p.select(
        key.alias("product_id"),
        F.col("p_name").alias("title"),
        F.when(key % 19 != 0, price).alias("price"),
        F.when(key % 17 != 0, rating).alias("rating"),
        F.concat(s(size * 13), F.lit(" ratings")).alias("total_reviews"),
        F.concat(s((size % 4 + 1) * 2), F.lit(" GB")).alias("ram"),
        ff.alias("form_factor"),
        F.when(key % 23 != 0, F.col("p_brand")).alias("manufacturer"),
        F.when(size % 3 == 0, F.lit("Android")).when(size % 3 == 1, F.lit("iOS")).alias("os"),
        F.split(F.col("p_name"), " ").getItem(0).alias("colour"),
        F.when(key % 11 == 0, F.lit("Out of stock")).otherwise(F.lit("In stock"))
         .alias("availability_status"),
        F.when(size % 4 == 0, F.lit("India")).when(size % 4 == 1, F.lit("China"))
         .when(size % 4 == 2, F.lit("Vietnam")).alias("country_of_origin"),
        F.col("p_type").alias("special_features"),
        F.concat(s(size * 10), F.lit(" g")).alias("weight"),
        s(size * 100).alias("battery_power_rating"),
    )
    return prod.join(packed_reviews(spark, sf_dir, short_lists), "product_id", "left")


def document_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unpacked documents as review rows (review key, text) for direct scoring."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("review_id"), F.col("text").alias("review_text"))
