"""Product cleaning and review flattening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean as C

REVIEW_ATTRS = ["title", "manufacturer", "category", "os", "colour",
                "price_clean", "rating_clean", "ram_gb"]


def clean_products(raw: DataFrame) -> DataFrame:
    """Raw product rows -> products with derived numeric columns and category.

    Raw columns are kept unchanged (any of them may be a model target).
    """
    return raw.select(
        "*",
        C.price_clean("price").alias("price_clean"),
        C.rating_clean("rating").alias("rating_clean"),
        C.reviews_count("total_reviews").alias("reviews_count"),
        C.ram_gb("ram").alias("ram_gb"),
        C.category_of("form_factor").alias("category"),
    )


def flatten_reviews(products: DataFrame, truncate: bool = True) -> DataFrame:
    """One row per packed review, paired with its star text.

    A NULL list reads as the single item 'nan' (as ``str(NaN)`` would), and the
    pairing stops at the shorter list (``truncate=True``, Q4); with
    ``truncate=False`` every review is kept and missing stars are NULL.
    Texts are stripped; blank and 'nan' texts are dropped (F9).
    Row-local: ``posexplode`` runs in the scan stage, no shuffle.
    """
    rev = F.split(F.coalesce(F.col("reviews"), F.lit("nan")), C.SEP, -1)
    rat = F.split(F.coalesce(F.col("reviews_rating"), F.lit("nan")), C.SEP, -1)
    # arrays_zip walks both lists once and pads the shorter one with NULL
    split = products.select("product_id", *REVIEW_ATTRS, rev.alias("_rev"), rat.alias("_rat"))
    n = F.least(F.size("_rev"), F.size("_rat")) if truncate else F.size("_rev")
    pairs = F.arrays_zip(F.slice("_rev", 1, n).alias("t"), F.slice("_rat", 1, n).alias("r"))
    exploded = split.select("product_id", *REVIEW_ATTRS,
                            F.posexplode(pairs).alias("review_pos", "pair"))
    text = C.trim_ws(F.col("pair.t"))
    return (exploded
            .select("product_id", F.col("review_pos").cast("int").alias("review_pos"),
                    *REVIEW_ATTRS[:5], text.alias("review_text"), *REVIEW_ATTRS[5:],
                    C.rating_clean(F.col("pair.r")).alias("star_rating"))
            .where((F.col("review_text") != "") & (F.lower("review_text") != "nan")))
