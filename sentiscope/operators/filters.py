"""F1-F17 filters and the product/review semi join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class FilterSpec:
    """Sidebar filters: None means 'All'; min_star 0 means no rating filter."""

    category: str | None = None
    brand: str | None = None
    price_range: tuple[float, float] | None = None
    min_star: float = 0.0


def price_bounds(products: DataFrame, faithful: bool = True) -> DataFrame:
    """default price slider bounds.

    ``faithful`` truncates both ends (int(min), int(max)), which hides a product
    priced above int(max) (Q3); otherwise the upper bound is ceil(max).
    """
    hi = F.max("price_clean")
    return products.agg(F.min("price_clean").cast("long").alias("price_lo"),
                        (hi.cast("long") if faithful else F.ceil(hi)).alias("price_hi"))


def _product_predicate(spec: FilterSpec, with_price: bool) -> F.Column:
    cond = F.lit(True)
    if spec.category is not None:
        cond = cond & (F.col("category") == spec.category)
    if spec.brand is not None:
        cond = cond & (F.col("manufacturer") == spec.brand)
    if with_price and spec.price_range is not None:
        lo, hi = spec.price_range
        cond = cond & (F.col("price_clean").between(lo, hi) | F.col("price_clean").isNull())
    if spec.min_star > 0:
        cond = cond & (F.col("rating_clean") >= spec.min_star)
    return cond


def apply_filters(products: DataFrame, reviews: DataFrame, spec: FilterSpec,
                  semi_join: bool = False) -> tuple[DataFrame, DataFrame]:
    """F1-F3 + J1: filtered products and the reviews of surviving products.

    Review rows carry their product's attributes (copied at flattening, and
    ``product_id`` is unique per product), so keeping reviews whose product
    survived equals applying the same predicate to the review rows: no join,
    no shuffle, and the filter reaches the scan. ``semi_join=True`` runs the
    literal left-semi join instead (for review tables without the attributes).
    """
    d = products.where(_product_predicate(spec, with_price=True))
    if semi_join:
        r = reviews.where(_product_predicate(spec, with_price=False))
        return d, r.join(d.select("product_id"), "product_id", "left_semi")
    return d, reviews.where(_product_predicate(spec, with_price=True))


def title_search(products: DataFrame, pattern: str, regex: bool = True) -> DataFrame:
    """case-insensitive title search; a regex by default; NULL titles never match."""
    if regex:
        cond = F.col("title").rlike("(?i)" + pattern)
    else:
        cond = F.lower("title").contains(pattern.lower())
    return products.where(F.coalesce(cond, F.lit(False)))


def product_by_title(products: DataFrame, title: str) -> DataFrame:
    """first product (lowest id) with exactly this title."""
    return products.where(F.col("title") == title).orderBy("product_id").limit(1)


def first_by_title(products: DataFrame) -> DataFrame:
    """F6 for every title: its product with the lowest id, one partial aggregate."""
    rest = [c for c in products.columns if c != "title"]
    first = F.min_by(F.struct(*rest), "product_id").alias("_p")
    return products.where(F.col("title").isNotNull()).groupBy("title").agg(first).select("title", "_p.*")


def reviews_of(reviews: DataFrame, product_id: int) -> DataFrame:
    """reviews of one product, from the unfiltered set."""
    return reviews.where(F.col("product_id") == product_id)


def by_sentiment(reviews: DataFrame, label: str) -> DataFrame:
    """F8."""
    return reviews.where(F.col("sentiment") == label)


def drop_nulls(df: DataFrame, cols: list[str]) -> DataFrame:
    """F10."""
    return df.dropna(subset=cols)
