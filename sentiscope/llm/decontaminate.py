"""Benchmark decontamination: document windows looked up in a set of benchmark windows.

A window is 10 consecutive words of an item (an item of fewer words is one
window). The windows are hashed into a table that is broadcast where its size
is checked to be small, and joined by shuffle otherwise. Documents are scanned
once: each position emits one row of 10 neighbouring words, whose hash is
probed; hits are verified word by word. Only hits are grouped afterwards.

Edge cases: null and empty texts have no words, so they are never hit and an
item without words has no window. Rows are told apart by doc_id and text, so
different texts under one doc_id, or without one, are judged each on its own.
An empty benchmark hits nothing; other columns are never read here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, small_enough, text_key, text_or_empty

WINDOW = 10
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def norm_words(text: Column) -> Column:
    """Lower-cased words of a text: digits, a-z and all non-ASCII characters."""
    return F.filter(F.split(ascii_lower(text), NOT_WORD), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, len, window_hash, window): every distinct window of every item."""
    w = benchmark.select("item_id", norm_words(text_or_empty()).alias("_w")).where(F.size("_w") > 0)
    w = w.withColumn("len", F.least(F.size("_w"), F.lit(window)))
    rows = w.select("item_id", "len", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("_w") - F.col("len") + 1),
        lambda p: F.array_join(F.slice("_w", p, F.col("len")), " "))).alias("window"))
    return rows.distinct().withColumn("window_hash", F.xxhash64("len", "window"))


def word_counts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_key().alias("_key"),
                       F.size(norm_words(text_or_empty())).cast("long").alias("n_words"))


def _same(doc_id: str, key: str) -> Column:
    """Whether a marked text, by these two columns, is the row's own."""
    return F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.col("_key") == F.col(key))


def hits(docs: DataFrame, windows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, _key, at, len, item_id): each place where a benchmark window occurs."""
    size = windows.agg(F.count(F.lit(1)).alias("n"),
                       F.coalesce(F.max(F.length("window")), F.lit(0)).alias("chars"),
                       F.collect_set("len").alias("lens")).first()  # at most `window` lengths
    lens = sorted(size["lens"]) or [window]
    # 4 bytes a character and 64 for the row's other columns bound a row from above
    side = F.broadcast(windows) if small_enough(size["n"], 4 * size["chars"] + 64) else windows
    w = docs.select("doc_id", text_key().alias("_key"), norm_words(text_or_empty()).alias("_w"))
    cols = [F.slice("_w", k + 1, F.greatest(F.size("_w") - k, F.lit(0))).alias(f"w{k}")
            for k in range(max(lens))]
    rows = w.select("doc_id", "_key", F.posexplode(F.arrays_zip(*cols)).alias("at", "x")).select(
        "doc_id", "_key", "at", *[F.col(f"x.w{k}").alias(f"w{k}") for k in range(max(lens))])

    def probe(n: int) -> DataFrame:
        return (rows.where(F.col(f"w{n - 1}").isNotNull())
                .select("doc_id", "_key", "at", F.lit(n).alias("len"),
                        F.concat_ws(" ", *[f"w{k}" for k in range(n)]).alias("window")))

    if len(lens) == 1:
        seen = probe(lens[0])
    else:  # one scan for all lengths
        texts = [F.when(F.col(f"w{n - 1}").isNotNull(),
                        F.struct(F.lit(n).alias("len"),
                                 F.concat_ws(" ", *[f"w{k}" for k in range(n)]).alias("window")))
                 for n in lens]
        seen = rows.select("doc_id", "_key", "at", F.explode(F.array(*texts)).alias("p")).where(
            "p is not null").select("doc_id", "_key", "at", "p.len", "p.window")
    seen = seen.withColumn("window_hash", F.xxhash64("len", "window"))
    return seen.join(side, ["window_hash", "len", "window"]).select("doc_id", "_key", "at", "len", "item_id")


def hit_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    found = materialize(hits(docs, benchmark_windows(benchmark, window), window), "decon-hits")
    places = found.select("doc_id", "_key", "at", "len").distinct()
    covered = (places.select("doc_id", "_key", F.explode(F.sequence("at", F.col("at") + F.col("len") - 1)).alias("p"))
               .groupBy("doc_id", "_key").agg(F.count_distinct("p").alias("n_hit")))
    items = (found.select(F.col("doc_id").alias("_i"), F.col("_key").alias("_ik"),
                          F.col("item_id").cast("string").alias("item_id")).distinct()
             .groupBy("_i", "_ik").agg(F.array_sort(F.collect_list("item_id")).alias("items")))
    marks = covered.join(items, _same("_i", "_ik"))
    marks = marks.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "n_hit", "items")
    return (word_counts(docs)
            .join(marks, _same("_d", "_k"), "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
                    (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))


def hit_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, _key, first, last): maximal runs of hit word positions."""
    found = hits(docs, benchmark_windows(benchmark, window), window)
    from pyspark.sql import Window
    w = Window.partitionBy("doc_id", "_key").orderBy("at")
    d = (found.groupBy("doc_id", "_key", "at").agg(F.max("len").alias("len"))
         .withColumn("end", F.col("at") + F.col("len") - 1))
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("new", F.coalesce((F.col("at") > reach + 1).cast("int"), F.lit(1)))
    d = d.withColumn("run", F.sum("new").over(w))
    return d.groupBy("doc_id", "_key", "run").agg(F.min("at").alias("first"), F.max("end").alias("last")).drop("run")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without any hit, rows unchanged."""
    bad = materialize(hits(docs, benchmark_windows(benchmark, window), window)
                      .select(F.col("doc_id").alias("_bad"), F.col("_key").alias("_k")).distinct(), "decon-bad")
    # names of docs can't clash
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), text_key().alias("_key"))
    same = F.col("_id").eqNullSafe(F.col("_bad")) & (F.col("_key") == F.col("_k"))
    return rows.join(bad, same, "left_anti").select("_row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents with their hit spans cut out; a document without hits keeps its text as it is.

    A cut text is rebuilt from its words and the separators that follow words kept.
    """
    spans = (hit_spans(docs, benchmark, window).groupBy("doc_id", "_key")
             .agg(F.collect_list(F.struct("first", "last")).alias("_spans"))
             .select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "_spans"))
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    pieces = F.regexp_extract_all(F.col("_row")["text"], F.lit(word), 0)
    kept = F.filter(pieces, lambda w, i: ~F.exists("_spans", lambda s: (i >= s["first"]) & (i <= s["last"])))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), text_key().alias("_key"))
    rows = rows.join(spans, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    text = F.when(F.col("_spans").isNull(), F.col("_row")["text"]).otherwise(F.array_join(kept, ""))
    return rows.select(F.col("_row").withField("text", text).alias("_row")).select("_row.*")
