"""Features and target preparation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions.lookups import (
    ENGLISH_STOP_WORDS,
    RATING_TARGETS,
    REGRESSION_TARGETS,
)
from ..sources.store import materialize
from .encoding import label_codes, label_encode  # noqa: F401

# Ranges of one round of exact selection.
SELECT_BUCKETS = 1024
HASH_MULT, HASH_MOD, ID_MOD = 2654435761, 4294967296, 2147483648
SPLIT_RANGES = 4096
# Frequent words, beyond the number of terms wanted only by ties, that may be broadcast.
FREQUENT_WORDS = 100_000
# Runs of two or more letters, digits or underscores (Unicode), like \w\w+ in Python.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


# --- exact quantiles without collecting a column -------------------------

def _stacked(df: DataFrame, cols: list[str]) -> DataFrame:
    """(c, x): the non-NULL, non-NaN values of every column, by column number."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("x")) for i, c in enumerate(cols)])).alias("s")
    ).select("s.c", "s.x").where(F.col("x").isNotNull() & ~F.isnan("x"))


def _ranked(stacked: DataFrame, stats: dict[int, tuple[int, float, float]]) -> dict[int, float]:
    """Per column, the lower middle value. ``stats``: (rows, least, greatest) of each column.

    All columns are narrowed together. A round counts the rows of at most
    SELECT_BUCKETS equal ranges of every open column (partial aggregates; a
    hot value is one row of the result) and goes on inside the range that
    holds the rank, between its own least and greatest value. The least and
    the greatest value never share a range, so every round shrinks the
    search, and it ends when one value is left. Infinite ends are a range of
    their own.
    """
    found: dict[int, float] = {}
    todo = {c: ((n - 1) // 2, lo, hi) for c, (n, lo, hi) in stats.items()}
    while todo:
        found |= {c: lo for c, (_, lo, hi) in todo.items() if lo == hi}
        todo = {c: t for c, t in todo.items() if t[1] < t[2]}
        if not todo:
            break
        x, b, inside = F.col("x"), F.lit(0), F.lit(False)
        for c, (_, lo, hi) in todo.items():
            own = F.col("c") == c
            if math.isinf(lo) or math.isinf(hi):
                at = F.when(x == float("-inf"), 0).when(x == float("inf"), 2).otherwise(1)
            else:  # halves, so that the width of the widest range is finite
                at = F.floor((x / 2 - lo / 2) / F.lit(hi / 2 - lo / 2) * SELECT_BUCKETS)
                at = F.when(x >= hi, SELECT_BUCKETS).otherwise(F.least(at, F.lit(SELECT_BUCKETS - 1)))
            b = F.when(own, at).otherwise(b)
            inside = inside | (own & x.between(lo, hi))
        rows = (stacked.where(inside).groupBy("c", b.cast("int").alias("b"))
                .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect())
        for c, (rank, _, _) in list(todo.items()):
            for r in sorted((r for r in rows if r["c"] == c), key=lambda r: r["b"]):
                if rank < r["n"]:
                    todo[c] = (rank, r["lo"], r["hi"])
                    break
                rank -= r["n"]
    return found


def exact_medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Exact median of each column (mean of the two middle values), NaN and NULL ignored."""
    stacked = _stacked(df, cols)
    stats = {r["c"]: (r["n"], r["lo"], r["hi"]) for r in stacked.groupBy("c").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
    low = _ranked(stacked, stats)
    out: dict[str, float | None] = {c: low.get(i) for i, c in enumerate(cols)}
    even = [i for i in low if stats[i][0] % 2 == 0]
    if even:  # the upper middle value: the same one, or the next
        of = F.coalesce(*[F.when(F.col("c") == i, F.lit(low[i])) for i in even])
        rows = stacked.where(F.col("c").isin(even)).groupBy("c").agg(
            F.count_if(F.col("x") <= of).alias("n"), F.min(F.when(F.col("x") > of, F.col("x"))).alias("next")).collect()
        for r in rows:
            a = low[r["c"]]
            if r["n"] < stats[r["c"]][0] // 2 + 1:
                out[cols[r["c"]]] = a / 2 + r["next"] / 2 if math.isinf(r["next"] - a) else a + (r["next"] - a) * 0.5
    return out


def exact_median(df: DataFrame, col: str | Column) -> float | None:
    """A20 for one column."""
    c = F.col(col) if isinstance(col, str) else col
    return exact_medians(df.select(c.alias("_x")), ["_x"])["_x"]


def median_impute(df: DataFrame, cols: list[str]) -> DataFrame:
    """M2: NULL/NaN -> the column's exact median (constants, one per column)."""
    meds = exact_medians(df, cols)
    out = df
    for c in cols:
        m = meds[c]
        fill = F.lit(m if m is not None else 0.0)
        out = out.withColumn(c, F.when(F.col(c).isNull() | F.isnan(c), fill).otherwise(F.col(c)))
    return out


# --- encodings, bins, classes ----------------------------------------------

def top_classes(df: DataFrame, col: str, k: int = 15, other: str = "Other",
                min_count: int = 4, fill: str = "Unknown") -> DataFrame:
    """A21 + F13: keep the k most frequent classes (ties by value), the rest -> Other;
    then drop classes with fewer than ``min_count`` rows.

    Both helper frames are bounded (k rows, at most k+1 classes), so they broadcast.
    """
    y = df.withColumn("_y", F.coalesce(F.col(col).cast("string"), F.lit(fill)))
    top = (y.groupBy("_y").agg(F.count(F.lit(1)).alias("_n"))
           .orderBy(F.desc("_n"), F.asc("_y")).limit(k).select("_y", F.lit(True).alias("_top")))
    y = (y.join(F.broadcast(top), "_y", "left")
         .withColumn("_y", F.when(F.col("_top"), F.col("_y")).otherwise(F.lit(other))).drop("_top"))
    keep = (y.groupBy("_y").agg(F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") >= min_count).select("_y"))
    return y.join(F.broadcast(keep), "_y", "left_semi").withColumnRenamed("_y", f"{col}_class")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows per class label and whether every label 0..max is present."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.min("n").alias("min_count"), F.max(label).alias("max_label"),
                 F.count(F.lit(1)).alias("classes"),
                 (F.count(F.lit(1)) == F.max(label) + 1).alias("no_gaps"))


# --- targets ----------------------------------------------------------------

def prepare_target(products: DataFrame, col: str) -> tuple[DataFrame, str]:
    """(product_id, y) for one column as target, and the task type."""
    if col in REGRESSION_TARGETS:
        d = products.select("product_id", C.parse_num(col).alias("y")).where(F.col("y").isNotNull())
        return d, "regression"
    if col in RATING_TARGETS:
        v = C.parse_num(col) if col == "rating" else C.parse_rev_rating(col)
        d = products.select("product_id", v.alias("_v")).where(F.col("_v").isNotNull())
        return d.select("product_id", C.rating_bins("_v").cast("double").alias("y")), "classification"
    if col == "reviews":
        return products.select("product_id", C.packed_len(col).cast("double").alias("y")), "regression"
    cls = top_classes(products.select("product_id", col), col)
    enc = label_encode(cls, f"{col}_class", "y")
    return enc.select("product_id", F.col("y").cast("double").alias("y")), "classification"


# --- sampling and splits ----------------------------------------------------

def row_hash(id_col: str = "product_id", seed: int = 42) -> Column:
    """Deterministic arithmetic hash of an integer id (identical in SQL engines).

    The id is taken modulo 2^31 first, so the product fits 64 bits for any id.
    """
    return ((F.pmod(F.col(id_col).cast("long"), F.lit(ID_MOD)) + seed) * HASH_MULT) % HASH_MOD


def sample_rows(df: DataFrame, n: int, id_col: str = "product_id", seed: int = 42) -> DataFrame:
    """Exactly n rows without replacement, repeatable (a sampling operator:
    the limit is the feature). ``orderBy(...).limit`` is a per-partition top-n."""
    return df.orderBy(row_hash(id_col, seed), F.col(id_col)).limit(n)


def split_flag(df: DataFrame, id_col: str = "product_id", test_fraction: float = 0.2,
               seed: int = 42) -> DataFrame:
    """Deterministic hash split, row-local (no shuffle).

    Each row goes to test when its hash falls under the fraction, so the share
    is exact in expectation only; ``split_stratified`` keeps exact class shares.
    """
    cut = int(test_fraction * 1000)
    return df.withColumn("is_test", (row_hash(id_col, seed) % 1000) < cut)


def split_stratified(df: DataFrame, label: str, id_col: str = "product_id", seed: int = 42) -> DataFrame:
    """Of each class, exactly a fifth (rounded half up) goes to test, those with the least hash.

    Rows are counted per class and hash range; only rows of the one range in
    which a class's quota ends are ranked, so no class is sorted in one task.
    """
    h = row_hash(id_col, seed)
    d = df.withColumn("_h", h).withColumn("_b", F.floor(F.col("_h") / (HASH_MOD // SPLIT_RANGES)).cast("int"))
    counts = d.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy(label)  # at most SPLIT_RANGES rows a class
    quota = F.floor((F.sum("_n").over(by) * 2 + 5) / 10)
    before = F.coalesce(F.sum("_n").over(by.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(label).alias("_l"), F.col("_b").alias("_rb"), (quota - before).alias("_left"), "_n")
    d = d.join(counts, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_rb"))).drop("_l", "_rb")
    split = (F.col("_left") > 0) & (F.col("_left") < F.col("_n"))
    whole = d.where(~split).withColumn("is_test", F.col("_left") > 0)
    rank = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", id_col))
    cut = d.where(split).withColumn("is_test", rank <= F.col("_left"))
    return whole.unionByName(cut).drop("_h", "_b", "_left", "_n")


# --- text features ----------------------------------------------------------

def term_lists(df: DataFrame, id_col: str, text_col: str, stops: list[str], ngram: int) -> DataFrame:
    """(id, _t): the terms of each text, in order, words before pairs."""
    d = df.select(id_col, words_of(text_col, stops).alias("_t"))
    return d.select(id_col, word_pairs("_t").alias("_t")) if ngram >= 2 else d


def words_of(text: str | Column, stops: list[str]) -> Column:
    """The words of a text, in order, without stop words."""
    text = F.col(text) if isinstance(text, str) else text
    toks = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), 0)
    return F.filter(toks, lambda t: ~t.isin(*stops)) if stops else toks


def word_pairs(words: str) -> Column:
    """A list of words followed by its pairs of neighbours."""
    n = F.size(words)
    nxt = F.slice(F.concat(F.col(words), F.array(F.lit(""))), 2, n)
    pairs = F.zip_with(F.col(words), nxt, lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, F.slice(pairs, 1, F.greatest(n - 1, F.lit(0))))


def top_terms(lists: DataFrame, col: str, most: int, pairs: bool) -> DataFrame:
    """(term): the ``most`` most frequent terms of (id, terms) rows, ties by term.

    With ``pairs`` the lists hold words and the pairs of neighbouring words, joined by a blank. A pair
    is no more frequent than either word, so only pairs of two words that reach the frequency of the
    last word wanted can be among the most frequent: words are counted first, and the long tail of
    pairs is never grouped.
    """
    terms = lists.select(F.explode(col).alias("term"))

    def best(of: DataFrame) -> DataFrame:
        return of.groupBy("term").agg(F.count(F.lit(1)).alias("cf")).orderBy(F.desc("cf"), F.asc("term")).limit(most)

    if not pairs:
        return best(terms).select("term")
    words = materialize(terms.where(~F.col("term").contains(" ")).groupBy("term").agg(F.count(F.lit(1)).alias("cf")), "terms-words")
    first = words.orderBy(F.desc("cf"), F.asc("term")).limit(most).select("cf").agg(F.count("cf").alias("n"), F.min("cf").alias("least")).first()
    if first["n"] < most:  # so few words that every term may be wanted
        return best(terms).select("term")
    words = materialize(words.where(F.col("cf") >= first["least"]), "terms-frequent")
    held = words.select(F.col("term").alias("_w"))
    held = F.broadcast(held) if words.count() <= FREQUENT_WORDS else held
    two = terms.where(F.col("term").contains(" "))
    for side in (1, -1):
        two = two.withColumn("_w", F.substring_index("term", " ", side)).join(held, "_w", "left_semi").drop("_w")
    pairs_cf = two.groupBy("term").agg(F.count(F.lit(1)).alias("cf"))
    return words.unionByName(pairs_cf).orderBy(F.desc("cf"), F.asc("term")).limit(most).select("term")


def tfidf(df: DataFrame, id_col: str, text_col: str, max_features: int,
          stops: list[str] | None = None, ngram: int = 1) -> DataFrame:
    """M4/M5: (id, term, weight) TF-IDF over the top ``max_features`` terms.

    idf = ln((1 + n) / (1 + df)) + 1 (smoothed, +1), rows L2-normalised.
    The lists are written once. Corpus counts are partial aggregates by term
    (``top_terms``), so the long tail of terms meets no (id, term) shuffle; only
    occurrences of the ``max_features`` terms (a parameter, hence their
    broadcasts) are grouped by row.
    """
    stops = ENGLISH_STOP_WORDS if stops is None else stops
    words = materialize(term_lists(df, id_col, text_col, stops, 1), "terms")
    n_docs = words.count()
    lists = words if ngram < 2 else words.select(id_col, word_pairs("_t").alias("_t"))
    top = materialize(top_terms(lists, "_t", max_features, ngram >= 2), "terms-top")
    kept = lists.select(id_col, F.explode("_t").alias("term")).join(F.broadcast(top), "term")
    tf = kept.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = tf.groupBy("term").agg((F.log((1.0 + n_docs) / (1.0 + F.count(F.lit(1)))) + 1.0).alias("idf"))
    w = tf.join(F.broadcast(idf), "term").select(id_col, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = w.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norms, id_col).select(id_col, "term", (F.col("w") / F.col("norm")).alias("weight"))


def standardize(df: DataFrame, cols: list[str], keep: list[str]) -> DataFrame:
    """M6: (x - mean) / population sd per column (sd 0 -> 0), like StandardScaler.

    One aggregate pass; the 2 x len(cols) statistics are bounded constants.
    """
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    st = df.agg(*aggs).first()
    out = [F.col(k) for k in keep]
    for c in cols:
        m, s = st[f"m_{c}"], st[f"s_{c}"]
        out.append(((F.col(c) - F.lit(m)) / F.lit(s)).alias(c) if s and not math.isnan(s)
                   else F.lit(0.0).alias(c))
    return df.select(*out)


# --- feature matrix ---------------------------------------------------------

NUMERIC = {
    "_price": lambda: C.parse_num("price"),
    "_rating": lambda: C.parse_num("rating"),
    "_revn": lambda: C.parse_num("total_reviews"),
    "_weight": lambda: C.parse_num("weight"),
    "_batt": lambda: C.lenient_double("battery_power_rating"),
    "_ravg": lambda: C.parse_rev_rating("reviews_rating"),
    "_rcnt": lambda: C.packed_len("reviews").cast("double"),
}
# target column -> the derived feature it produces (left out when it is the target)
TARGET_FEATURE = {"price": "_price", "rating": "_rating", "total_reviews": "_revn",
                  "weight": "_weight", "battery_power_rating": "_batt",
                  "reviews_rating": "_ravg", "reviews": "_rcnt"}
