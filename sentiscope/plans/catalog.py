"""Registered queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables through the stand-in adapter
(``sources.testdata``) and runs the library's operators over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions.lexicons import fixture_resources
from ..operators import analytics as A
from ..operators.filters import FilterSpec, apply_filters, first_by_title, price_bounds, title_search
from ..operators.reviews import clean_products, flatten_reviews
from ..operators.sentiment import score_basic, score_full, score_reviews
from ..sources.scored import ScoredTable
from ..sources.store import fresh_path
from ..sources.testdata import document_reviews, raw_products

# Scoring mode used by the analytics queries.
ANALYTICS_SCORING = "full"
# Filter settings of the filtered KPI query (a fixed sidebar state).
KPI_FILTER = FilterSpec(category="Smartphone", brand=None, price_range=(5000.0, 40000.0),
                        min_star=2.5)
SEARCH_PATTERN = "red|blue"


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_products(raw_products(spark, sf_dir))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_reviews(products(spark, sf_dir))


def _score(products: DataFrame) -> DataFrame:
    return score_reviews(flatten_reviews(products), fixture_resources(products.sparkSession), ANALYTICS_SCORING)


#: Scored tables of a session, by table folder: the analytics queries share one.
_SCORED: dict[tuple[str, str], ScoredTable] = {}


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SCORED:
        table = ScoredTable(spark, fresh_path(spark, "scored"), _score)
        table.build(products(spark, sf_dir))
        _SCORED[key] = table
    return _SCORED[key].read()


# --- cleaning, flattening, scoring ---------------------------------------

def q_scored_update(spark, sf_dir):
    """A scored table built from older products, brought up to date by the changed ones alone.

    Of the older products every tenth one was in another category or lacked its reviews.
    """
    now = products(spark, sf_dir)
    old = now.withColumns({
        "category": F.when(F.col("product_id") % 10 == 3, F.lit("Other")).otherwise(F.col("category")),
        "reviews": F.when(F.col("product_id") % 10 == 7, F.lit(None)).otherwise(F.col("reviews"))})
    table = ScoredTable(spark, fresh_path(spark, "scored-old"), _score)
    table.build(old)
    table.update(now, now.where(F.col("product_id") % 10 % 4 == 3).select("product_id"))
    return table.read().select("product_id", "review_pos", "category", "sentiment", "compound", "star_rating")


def q_clean_products(spark, sf_dir):
    return products(spark, sf_dir).select(
        "product_id", "title", "manufacturer", "form_factor", "price", "rating",
        "price_clean", "rating_clean", "reviews_count", "ram_gb", "category",
        C.parse_num("price").alias("price_num"), C.parse_price("price").alias("price_parsed"))


def q_category_map(spark, sf_dir):
    p = products(spark, sf_dir)
    return (p.groupBy("form_factor", "category").agg(F.count(F.lit(1)).alias("products"))
            .withColumn("icon", C.icon_of("category")))


def q_flatten_reviews(spark, sf_dir):
    """Reviews paired with their stars, where some products have one star text too few."""
    return flatten_reviews(clean_products(raw_products(spark, sf_dir, short_lists=True)))


def q_score_basic(spark, sf_dir):
    return score_basic(document_reviews(spark, sf_dir), ["review_id"], "review_text",
                       fixture_resources(spark)).drop("review_text")


def q_score_full(spark, sf_dir):
    return score_full(document_reviews(spark, sf_dir), ["review_id"], "review_text",
                      fixture_resources(spark)).drop("review_text")


def q_packed_ratings(spark, sf_dir):
    p = products(spark, sf_dir)
    return p.select("product_id",
                    C.parse_rev_rating("reviews_rating").alias("review_rating_avg"),
                    C.packed_len("reviews").alias("review_count"),
                    C.packed_len_filled("reviews").alias("review_count_filled"),
                    C.lenient_double("battery_power_rating").alias("battery"),
                    C.parse_num("weight").alias("weight_num"))


# --- filters and KPIs ------------------------------------------------------

def q_sentiment_counts(spark, sf_dir):
    return A.sentiment_counts(scored(spark, sf_dir))


def q_filtered_kpis(spark, sf_dir):
    d, r = apply_filters(products(spark, sf_dir), scored(spark, sf_dir), KPI_FILTER)
    return A.kpis(d, r)


def q_price_bounds(spark, sf_dir):
    return price_bounds(products(spark, sf_dir))


def q_product_search(spark, sf_dir):
    return title_search(products(spark, sf_dir), SEARCH_PATTERN).select(
        "product_id", "title", "manufacturer", "category", "price_clean", "rating_clean")


def q_product_card(spark, sf_dir):
    return A.product_sentiment(scored(spark, sf_dir))


# --- brand tab -------------------------------------------------------------

def q_brand_kpis(spark, sf_dir):
    return A.group_kpis(products(spark, sf_dir), scored(spark, sf_dir), "manufacturer")


def q_brand_category_mix(spark, sf_dir):
    return A.brand_category_mix(products(spark, sf_dir))


def q_brand_category_scores(spark, sf_dir):
    return A.group_scores(scored(spark, sf_dir), ["manufacturer", "category"])


def q_brand_top_titles(spark, sf_dir):
    return A.top_titles(scored(spark, sf_dir), "manufacturer", 10)


# --- category tab ----------------------------------------------------------

def q_category_kpis(spark, sf_dir):
    return A.group_kpis(products(spark, sf_dir), scored(spark, sf_dir), "category")


def q_category_brands(spark, sf_dir):
    return A.group_scores(scored(spark, sf_dir), ["category", "manufacturer"])


def q_category_best_titles(spark, sf_dir):
    return A.top_titles(scored(spark, sf_dir), "category", 10)


def q_top_rated(spark, sf_dir):
    return A.top_rated(products(spark, sf_dir), 10)


# --- overall tab -----------------------------------------------------------

def q_category_table(spark, sf_dir):
    return A.sentiment_table(scored(spark, sf_dir), "category")


def q_brand_table(spark, sf_dir):
    return A.sentiment_table(scored(spark, sf_dir), "manufacturer")


def q_brand_top40_long(spark, sf_dir):
    return A.brand_top40_long(scored(spark, sf_dir), 40)


def q_brand_category_heatmap(spark, sf_dir):
    return A.brand_category_heatmap(scored(spark, sf_dir), 30)


def q_score_histogram(spark, sf_dir):
    return A.score_histogram(scored(spark, sf_dir), 80)


def q_sentiment_breakdown(spark, sf_dir):
    return A.sentiment_breakdown(scored(spark, sf_dir), "category")


def q_price_rating_pairs(spark, sf_dir):
    return A.price_rating_pairs(products(spark, sf_dir), 3)


def q_top_positive(spark, sf_dir):
    return A.top_reviews(scored(spark, sf_dir), "Positive", 5)


def q_top_negative(spark, sf_dir):
    return A.top_reviews(scored(spark, sf_dir), "Negative", 5)


def q_category_top_reviews(spark, sf_dir):
    return A.top_reviews(scored(spark, sf_dir), "Positive", 6, group="category")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "clean_products": q_clean_products,
    "category_map": q_category_map,
    "flatten_reviews": q_flatten_reviews,
    "score_basic": q_score_basic,
    "score_full": q_score_full,
    "packed_ratings": q_packed_ratings,
    "sentiment_counts": q_sentiment_counts,
    "filtered_kpis": q_filtered_kpis,
    "price_bounds": q_price_bounds,
    "product_search": q_product_search,
    "product_card": q_product_card,
    "brand_kpis": q_brand_kpis,
    "brand_category_mix": q_brand_category_mix,
    "brand_category_scores": q_brand_category_scores,
    "brand_top_titles": q_brand_top_titles,
    "category_kpis": q_category_kpis,
    "category_brands": q_category_brands,
    "category_best_titles": q_category_best_titles,
    "top_rated": q_top_rated,
    "category_table": q_category_table,
    "brand_table": q_brand_table,
    "brand_top40_long": q_brand_top40_long,
    "brand_category_heatmap": q_brand_category_heatmap,
    "score_histogram": q_score_histogram,
    "sentiment_breakdown": q_sentiment_breakdown,
    "price_rating_pairs": q_price_rating_pairs,
    "top_positive": q_top_positive,
    "top_negative": q_top_negative,
    "category_top_reviews": q_category_top_reviews,
}


# --- features, neighbours, metrics ----------------------------------------

from ..functions.lookups import NEGATIVE, NEUTRAL, POSITIVE  # noqa: E402
from ..operators import features as FE  # noqa: E402
from ..operators import neighbors as NB  # noqa: E402
from ..operators import scoreboard as SB  # noqa: E402
from ..operators.evaluate import classification_metrics, regression_metrics  # noqa: E402
from ..streaming.events import daily_event_windows, sentiment_windows  # noqa: E402

NUMERIC_COLS = ["_price", "_rating", "_revn", "_weight", "_batt", "_ravg", "_rcnt"]


def numeric_features(spark, sf_dir):
    p = products(spark, sf_dir)
    return p.select("product_id", *[FE.NUMERIC[k]().alias(k) for k in NUMERIC_COLS])


def q_median_impute(spark, sf_dir):
    return FE.median_impute(numeric_features(spark, sf_dir), NUMERIC_COLS)


def q_label_encode(spark, sf_dir):
    return FE.label_encode(products(spark, sf_dir).select("product_id", "manufacturer"),
                           "manufacturer", "manufacturer_code")


def q_rating_bins(spark, sf_dir):
    p = products(spark, sf_dir)
    return p.select("product_id", C.parse_num("rating").alias("rating_num"),
                    C.rating_bins(C.parse_num("rating")).alias("rating_bin"),
                    C.sentiment_bins(C.parse_rev_rating("reviews_rating")).alias("review_bin"))


def q_rare_class_filter(spark, sf_dir):
    return FE.top_classes(products(spark, sf_dir).select("product_id", "title"), "title")


def q_prepare_target(spark, sf_dir):
    y, _ = FE.prepare_target(products(spark, sf_dir), "rating")
    return y


def q_tfidf_titles(spark, sf_dir):
    t = FE.tfidf(products(spark, sf_dir), "product_id", "title", 60)
    return t.withColumn("weight", F.bround("weight", 6))


def q_tfidf_bigrams(spark, sf_dir):
    p = products(spark, sf_dir).withColumn("rev_text", F.coalesce("reviews", F.lit("no review")))
    t = FE.tfidf(p, "product_id", "rev_text", 500, ngram=2)
    return t.withColumn("weight", F.bround("weight", 6))


def q_standardize(spark, sf_dir):
    p = products(spark, sf_dir)
    s = FE.standardize(p, ["reviews_count", "ram_gb"], ["product_id"])
    return s.select("product_id", *[F.bround(c, 6).alias(c) for c in ["reviews_count", "ram_gb"]])


def embeddings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def q_sample_rows(spark, sf_dir):
    return FE.sample_rows(embeddings(spark, sf_dir).select("vec_id", "label"), 300, "vec_id")


def q_split_stratified(spark, sf_dir):
    y, _ = FE.prepare_target(products(spark, sf_dir), "rating")
    s = FE.split_stratified(y, "y", "product_id")
    return s.groupBy("y", "is_test").agg(F.count(F.lit(1)).alias("rows"))


def q_content_knn(spark, sf_dir):
    return NB.content_knn(embeddings(spark, sf_dir), "vec_id", "embedding", "label",
                          "classification", n=300, k=5)


def q_svd_knn(spark, sf_dir):
    out, _ = NB.svd_knn(embeddings(spark, sf_dir), "vec_id", "embedding", "label",
                        "classification", n=600, k=7, components=15)
    return out


def _star_vs_label(spark, sf_dir):
    s = scored(spark, sf_dir).where(F.col("star_rating").isNotNull())
    pred = (F.when(F.col("sentiment") == NEGATIVE, 0).when(F.col("sentiment") == NEUTRAL, 1)
            .when(F.col("sentiment") == POSITIVE, 2))
    return s.select(C.sentiment_bins("star_rating").cast("double").alias("label"),
                    pred.cast("double").alias("prediction"), "star_rating", "compound")


def q_weighted_metrics(spark, sf_dir):
    """How well the lexicon label predicts the star class (P24 bins of star ratings)."""
    return classification_metrics(_star_vs_label(spark, sf_dir))


def q_regression_metrics(spark, sf_dir):
    """Star rating predicted as 3 + 2 * compound."""
    s = _star_vs_label(spark, sf_dir)
    return regression_metrics(s.select(F.col("star_rating").alias("label"),
                                       (F.lit(3.0) + 2.0 * F.col("compound")).alias("prediction")))


def q_product_detail(spark, sf_dir):
    """Every product's card: display values, number of reviews, mean stars."""
    p = products(spark, sf_dir)
    return A.product_cards(p, flatten_reviews(p))


WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
SCORE_AT = 35


def model_results(spark, sf_dir):
    """Stand-in results table from ``events``: event types as targets, weekdays as models, the
    share of events with a value of SCORE_AT or more as score."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.weekday("ts")
    named = ev.select(F.col("event_type").alias("target"), F.array_position(F.lit(EVENT_TYPES), F.col("event_type")).cast("int")
                      .alias("target_order"), F.element_at(F.lit(WEEKDAYS), day + 1).alias("model"), day.alias("model_order"), "value")
    return named.groupBy("target", "target_order", "model", "model_order").agg(
        (F.count_if(F.col("value") >= SCORE_AT) / F.count("value")).alias("score"))


def _rounded(df, cols):
    return df.withColumns({c: F.round(c, 9) for c in cols})


def q_model_scoreboard(spark, sf_dir):
    """Mean of the best scores, the most frequent winner and the single best of the results table."""
    return _rounded(SB.scoreboard(model_results(spark, sf_dir)), ["mean_best_score", "best_score"])


def q_best_per_target(spark, sf_dir):
    return _rounded(SB.best_per_column(model_results(spark, sf_dir), EVENT_TYPES + ["none"]), ["score"])


def q_score_shares(spark, sf_dir):
    """Deviations, waterfall steps, shares, ranks and percentages of every model of a target."""
    out = SB.score_features(model_results(spark, sf_dir)).drop("bubble")
    return _rounded(out, ["score", "deviation", "step", "step_base", "share", "ratio_to_best", "share_offset"])


def q_score_matrix(spark, sf_dir):
    return _rounded(SB.score_matrix(model_results(spark, sf_dir), EVENT_TYPES), EVENT_TYPES)


def q_event_windows(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return daily_event_windows(ev)


QUERIES.update({
    "median_impute": q_median_impute,
    "label_encode": q_label_encode,
    "rating_bins": q_rating_bins,
    "rare_class_filter": q_rare_class_filter,
    "prepare_target": q_prepare_target,
    "tfidf_titles": q_tfidf_titles,
    "tfidf_bigrams": q_tfidf_bigrams,
    "standardize": q_standardize,
    "sample_rows": q_sample_rows,
    "split_stratified": q_split_stratified,
    "content_knn": q_content_knn,
    "svd_knn": q_svd_knn,
    "weighted_metrics": q_weighted_metrics,
    "regression_metrics": q_regression_metrics,
    "event_windows": q_event_windows,
    "product_detail": q_product_detail,
    "model_scoreboard": q_model_scoreboard,
    "best_per_target": q_best_per_target,
    "score_shares": q_score_shares,
    "score_matrix": q_score_matrix,
})
from .training import QUERIES as TRAINING_QUERIES  # noqa: E402

QUERIES.update(TRAINING_QUERIES)
QUERIES["scored_update"] = q_scored_update


def q_product_by_title(spark, sf_dir):
    """what a lookup of each exact title finds."""
    return first_by_title(products(spark, sf_dir).select("product_id", "title", "category", "price_clean", "rating_clean"))


def q_filter_options(spark, sf_dir):
    """The values that each filter offers, with their places in order."""
    p = products(spark, sf_dir)
    cols = ["category", "manufacturer", "os"]
    names = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("c") + 1)
    known = [FE.label_codes(A.distinct_values(p, c), [c]).select(F.lit(i).alias("c"), "label", "code") for i, c in enumerate(cols)]
    return known[0].unionByName(known[1]).unionByName(known[2]).select(names.alias("filter"), F.col("label").alias("value"), F.col("code").alias("place"))


def q_score_bubbles(spark, sf_dir):
    """Bubble size of every score of the results table."""
    out = SB.score_features(model_results(spark, sf_dir)).select("target", "model", "bubble")
    return out.withColumn("bubble", F.bround("bubble", 6))


QUERIES.update({"product_by_title": q_product_by_title, "filter_options": q_filter_options, "score_bubbles": q_score_bubbles})


def q_sentiment_windows(spark, sf_dir):
    """E2 in batch form over the scored reviews, with an event time made from product and place."""
    hours = (F.col("product_id") % 40) * 24 + F.col("review_pos") * 7
    ts = F.timestamp_add("HOUR", hours.cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return sentiment_windows(scored(spark, sf_dir).withColumn("ts", ts))


QUERIES["sentiment_windows"] = q_sentiment_windows
