"""Counts, KPIs, rankings, breakdowns, pivot and histogram.

Conventions:

* group keys are filtered ``IS NOT NULL`` (pandas ``groupby`` drops NULL keys);
* means of ``compound`` are exact (integer ten-thousandths, ``avg_e4``);
* every top-k has a full tie-break, and per-group top-k uses
  ``row_number() <= k`` so Spark plans a partial ``WindowGroupLimit`` before
  the shuffle (a hot group never ships more than k rows per map task);
* product-level and review-level aggregates are computed in one pass over a
  union of both tables instead of joining two aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions.lookups import CATEGORY_ICON, NEGATIVE, NEUTRAL, POSITIVE, SENTIMENT_LABELS



def _is(label: str):
    return F.col("sentiment") == label

CATEGORIES = list(CATEGORY_ICON)  # every category P5 can emit, plus Other


def _nn(df: DataFrame, *keys: str) -> DataFrame:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.where(cond)


def sentiment_counts(reviews: DataFrame) -> DataFrame:
    """A1: overall positive / negative / neutral counts and total, one pass."""
    return reviews.agg(F.count_if(_is(POSITIVE)).alias("positive"), F.count_if(_is(NEGATIVE)).alias("negative"),
                       F.count_if(_is(NEUTRAL)).alias("neutral"), F.count(F.lit(1)).alias("total"))


def _product_aggs() -> list:
    return [F.count(F.lit(1)).alias("products"), F.count_distinct("category").alias("categories"),
            F.count_distinct("manufacturer").alias("brands")]


def _review_aggs() -> list:
    n = F.count(F.lit(1))
    return [n.alias("reviews"), F.count_if(_is(POSITIVE)).alias("positive"), F.count_if(_is(NEGATIVE)).alias("negative"),
            F.count_if(_is(NEUTRAL)).alias("neutral"), C.safe_share(F.count_if(_is(POSITIVE)), n).alias("pos_share"),
            C.safe_share(F.count_if(_is(NEGATIVE)), n).alias("neg_share"),
            F.coalesce(C.avg_e4("compound"), F.lit(0.0)).alias("avg_compound")]


_PRODUCT_KPIS = ["products", "categories", "brands"]
_REVIEW_COUNTS = ["reviews", "positive", "negative", "neutral"]
_REVIEW_KPIS = ["pos_share", "neg_share", "avg_compound"]


def kpis(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """A2/A3: KPI strip of (filtered) products and reviews: two one-row results side by side."""
    p = products.agg(*_product_aggs()).withColumn("_one", F.lit(1))
    r = reviews.agg(*_review_aggs()).withColumn("_one", F.lit(1))
    return p.join(r, "_one").drop("_one")


def group_kpis(products: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """A6 (key=manufacturer) / A7 (key=category): the KPI strip for every group at once.

    Products and reviews are aggregated each on their own, so distinct counts
    run over products only, and the small results are joined.
    """
    p = _nn(products, key).groupBy(F.col(key).alias("_key")).agg(*_product_aggs())
    r = _nn(reviews, key).groupBy(F.col(key).alias("_key")).agg(*_review_aggs())
    j = p.join(r, "_key", "full")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _PRODUCT_KPIS + _REVIEW_COUNTS]
    return j.select(F.col("_key").alias(key), *zero, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in _REVIEW_KPIS])


def product_cards(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Each product's display values, the number of its reviews and their mean stars."""
    card = products.select(
        "product_id", "title", "category", C.price_display("price_clean").alias("price"),
        C.rating_display("rating_clean").alias("rating"), C.ram_display("ram_gb").alias("ram"),
        C.battery_display(C.lenient_double("battery_power_rating")).alias("battery"))
    own = reviews.groupBy("product_id").agg(F.count(F.lit(1)).alias("reviews"),
                                            C.rating_display(F.avg("star_rating")).alias("stars"))
    return card.join(own, "product_id", "left").withColumns(
        {"reviews": F.coalesce("reviews", F.lit(0)).cast("long"), "stars": F.coalesce("stars", F.lit("N/A"))})


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """A4: sorted distinct non-NULL values."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def product_sentiment(reviews: DataFrame) -> DataFrame:
    """A5 for every product: counts, shares and mean score (rounded to 3, half-even)."""
    n = F.count(F.lit(1))
    return reviews.groupBy("product_id").agg(
        n.alias("reviews"), F.count_if(_is(POSITIVE)).alias("positive"), F.count_if(_is(NEGATIVE)).alias("negative"),
        F.count_if(_is(NEUTRAL)).alias("neutral"),
        C.pct1(F.count_if(_is(POSITIVE)), n).alias("pos_pct"), C.pct1(F.count_if(_is(NEGATIVE)), n).alias("neg_pct"),
        C.round_ratio(F.sum(C.e4("compound")), n * 10, 3).alias("avg_compound"))


def brand_category_mix(products: DataFrame) -> DataFrame:
    """Products per category within each brand."""
    return (_nn(products, "manufacturer").groupBy("manufacturer", "category")
            .agg(F.count(F.lit(1)).alias("products")))


def group_scores(reviews: DataFrame, keys: list[str]) -> DataFrame:
    """Mean compound and non-NULL count per group."""
    return (_nn(reviews, *keys).groupBy(*keys)
            .agg(C.avg_e4("compound").alias("avg_compound"),
                 F.count("compound").alias("reviews")))


def top_per_group(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """Top k rows per group by ``order`` (row_number <= k -> WindowGroupLimit)."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def top_titles(reviews: DataFrame, group: str, k: int = 10) -> DataFrame:
    """A10 (group=manufacturer) / A12 (group=category): best titles by mean compound.

    Titles are grouped by name, so one title from two brands merges (Q8).
    """
    s = (_nn(reviews, group, "title").groupBy(group, "title")
         .agg(F.sum(C.e4("compound")).alias("_s"), F.count("compound").alias("reviews")))
    s = s.select(group, "title", "reviews",
                 (F.col("_s") / F.col("reviews") / F.lit(10000.0)).alias("avg_compound"),
                 C.round_ratio("_s", F.col("reviews") * 10, 3).alias("avg_vader"))
    return top_per_group(s, group, [F.desc("avg_compound"), F.asc("title")], k)


def top_rated(products: DataFrame, k: int = 10) -> DataFrame:
    """Highest rated products per category (NULL ratings dropped)."""
    p = _nn(products, "rating_clean", "category").select(
        "category", "product_id", "title", "manufacturer", "price_clean", "rating_clean")
    return top_per_group(p, "category", [F.desc("rating_clean"), F.asc("product_id")], k)


def sentiment_table(reviews: DataFrame, key: str) -> DataFrame:
    """A13 (key=category, with icon and label) / A14 (key=manufacturer)."""
    total = F.count("sentiment")
    out = _nn(reviews, key).groupBy(key).agg(
        F.count_if(_is(POSITIVE)).alias("pos"), F.count_if(_is(NEGATIVE)).alias("neg"), total.alias("total"),
        C.avg_e4("compound").alias("avg_score"),
        C.pct1(F.count_if(_is(POSITIVE)), total).alias("pos_pct"),
        C.pct1(F.count_if(_is(NEGATIVE)), total).alias("neg_pct"),
        C.round_ratio(F.sum(C.e4("compound")), total * 10, 3).alias("avg_vader"))
    if key == "category":
        out = out.withColumn("icon", C.icon_of("category")).withColumn(
            "cat_label", F.concat_ws("  ", F.col("icon"), F.col("category")))
    return out


def brand_top40_long(reviews: DataFrame, k: int = 40) -> DataFrame:
    """A18 + T4: top k brands by mean score, pos/neg percentages in long form."""
    top = (sentiment_table(reviews, "manufacturer")
           .orderBy(F.desc("avg_score"), F.asc("manufacturer")).limit(k))
    return top.unpivot(["manufacturer", "avg_score"], ["pos_pct", "neg_pct"], "variable", "value")


def top_brands_by_reviews(reviews: DataFrame, k: int = 30) -> DataFrame:
    """T5: k brands with most reviews (ties by name)."""
    return (_nn(reviews, "manufacturer").groupBy("manufacturer")
            .agg(F.count("compound").alias("reviews"))
            .orderBy(F.desc("reviews"), F.asc("manufacturer")).limit(k))


def brand_category_heatmap(reviews: DataFrame, k: int = 30) -> DataFrame:
    """A15 + T5 + J2 + F16: brand x category mean score for the top-k brands, 0 when empty.

    The top-k frame has at most k rows (a proven bound), so the semi join
    broadcasts it; pivot columns are the fixed category list.
    """
    top = F.broadcast(top_brands_by_reviews(reviews, k).select("manufacturer"))
    r = _nn(reviews, "manufacturer").join(top, "manufacturer", "left_semi")
    piv = (r.groupBy("manufacturer").pivot("category", CATEGORIES)
           .agg((F.try_divide(F.sum(C.e4("compound")), F.count("compound")) / F.lit(10000.0))))
    return piv.fillna(0.0, subset=CATEGORIES)


def score_histogram(reviews: DataFrame, bins: int = 80) -> DataFrame:
    """Counts per sentiment and equal-width bin of compound over [-1, 1].

    Bins are computed on integer ten-thousandths (exact edges); the maximum
    1.0 falls in the last bin.
    """
    width = 20000 // bins
    b = F.least(F.floor((C.e4("compound") + 10000) / F.lit(width)).cast("int") + 1, F.lit(bins))
    return (reviews.groupBy("sentiment", b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("reviews"))
            .withColumn("bin_lo", (F.col("bin") - 1) * width / F.lit(10000.0) - 1.0))


def sentiment_breakdown(reviews: DataFrame, key: str = "category") -> DataFrame:
    """Three rows (Positive, Neutral, Negative) per group, zero-filled."""
    wide = _nn(reviews, key).groupBy(key).agg(
        F.count_if(_is(POSITIVE)).alias(POSITIVE), F.count_if(_is(NEUTRAL)).alias(NEUTRAL),
        F.count_if(_is(NEGATIVE)).alias(NEGATIVE))
    return wide.unpivot([key], SENTIMENT_LABELS, "sentiment", "reviews")


def price_rating_pairs(products: DataFrame, min_prices: int = 3) -> DataFrame:
    """A19 + F10/F11: (price, rating) points of categories with > min_prices prices.

    The per-category counts have one row per category (at most the fixed
    category list), so the guard joins by broadcast.
    """
    counts = (products.groupBy("category").agg(F.count("price_clean").alias("_n"))
              .where(F.col("_n") > min_prices).select("category"))
    p = products.dropna(subset=["price_clean", "rating_clean"])
    return p.join(F.broadcast(counts), "category", "left_semi").select(
        "category", "product_id", "manufacturer", "title", "price_clean", "rating_clean")


def top_reviews(reviews: DataFrame, label: str, n: int = 5, group: str | None = None) -> DataFrame:
    """T1 (Positive, strongest first) / T2 (Negative, most negative first).

    Global form is ``orderBy().limit()`` -> TakeOrderedAndProject; with a group
    it is a per-group top n.
    """
    order = ([F.desc("compound")] if label == POSITIVE else [F.asc("compound")]) + \
        [F.asc("product_id"), F.asc("review_pos")]
    r = reviews.where(F.col("sentiment") == label).select(
        "product_id", "review_pos", "title", "manufacturer", "category", "compound", "review_text")
    if group is None:
        return r.orderBy(*order).limit(n)
    return top_per_group(_nn(r, group), group, order, n)
