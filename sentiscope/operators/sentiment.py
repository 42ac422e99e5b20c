"""Lexicon sentiment scoring as a DataFrame job.

Plan shape (per call):

* one projection per text builds the token array and, per token, a struct with
  its 3 preceding and 2 following tokens, so ``explode`` never copies the whole
  array into each output row;
* one inner join against the vocabulary keeps lexicon hits only; four left joins
  add context flags to the hits. Vocabulary and phrase tables are measured (they
  come without statistics) and broadcast up to BROADCAST_BYTES;
* cases of the neighbours are looked at on hits only;
* rule arithmetic is plain column expressions (whole-stage codegen);
* ``groupBy(review key)`` sums per review: tokens of a review sit in one input
  partition, so the partial aggregate collapses them before the shuffle;
* the per-review sums are joined back to the review rows on their unique key.

No window, no Python UDF, no token-level shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions.lexicons import (
    C_INCR,
    EXCLAIM_MAX,
    EXCLAIM_STEP,
    N_SCALAR,
    NORMALIZE_ALPHA,
    QUESTION_MAX_AMP,
    QUESTION_STEP,
    SentimentResources,
)

PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"  # Python's string.punctuation
WS_SPLIT = r"(?U)\s+"

# Largest resource table that is broadcast, by the length of its terms and ROW_BYTES a row.
BROADCAST_BYTES, ROW_BYTES = 32 * 1024 * 1024, 64

SCORE_COLUMNS = ["compound", "pos_score", "neg_score", "neu_score", "sentiment"]


def _broadcast_if_small(df: DataFrame, key: str) -> DataFrame:
    """``df`` hinted for broadcast if it is small. Tables made of local rows count as endless for the
    planner, which then shuffles every token to meet them."""
    size = df.agg(F.sum(F.octet_length(key) + ROW_BYTES).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def vocabulary(res: SentimentResources) -> DataFrame:
    """term -> (valence, booster, is_neg); one row per lower-cased term."""
    lex = res.lexicon.select(F.lower("term").alias("term"), F.col("valence").cast("double"))
    boo = res.boosters.select(F.lower("term").alias("term"), F.col("scalar").cast("double").alias("booster"))
    neg = res.negations.select(F.lower("term").alias("term"), F.lit(True).alias("is_neg"))
    return (lex.unionByName(boo, allowMissingColumns=True)
            .unionByName(neg, allowMissingColumns=True)
            .groupBy("term")
            .agg(F.max("valence").alias("valence"), F.max("booster").alias("booster"),
                 F.max("is_neg").alias("is_neg")))


def _is_upper(t: Column) -> Column:
    """Python ``str.isupper``: has a cased character and none in lower case."""
    return (t == F.upper(t)) & (t != F.lower(t))


def _raw_tokens(text: Column) -> Column:
    return F.filter(F.split(text, WS_SPLIT), lambda t: t != "")


def _tokens(text: Column) -> Column:
    """V1: whitespace split; edge punctuation stripped unless <= 2 characters would remain."""
    def strip(t):
        s = F.btrim(t, F.lit(PUNCT))
        return F.when(F.length(s) <= 2, t).otherwise(s)

    return F.transform(_raw_tokens(text), strip)


def _count_char(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def _punct_amplifier(text: Column) -> Column:
    """V7: '!' up to 4 x 0.292; '?' x 0.18 each when 2-3, 0.96 when more."""
    ep = F.least(_count_char(text, "!"), F.lit(EXCLAIM_MAX)) * EXCLAIM_STEP
    qm = _count_char(text, "?")
    qa = F.when(qm > 3, QUESTION_MAX_AMP).when(qm > 1, qm * QUESTION_STEP).otherwise(0.0)
    return ep + qa


def _shift(arr: str, k: int, n: Column, typ: str) -> Column:
    """Array shifted right by k (k > 0: previous items) or left by -k, same length, NULL padded."""
    pad = F.array_repeat(F.lit(None).cast(typ), abs(k))
    if k > 0:
        return F.slice(F.concat(pad, F.col(arr)), 1, n)
    return F.slice(F.concat(F.col(arr), pad), -k + 1, n)


def _negated(word: Column, is_neg: Column) -> Column:
    return F.coalesce(is_neg, F.lit(False)) | F.coalesce(word.contains("n't"), F.lit(False))


def _phrases(df: DataFrame, key: str, value: str) -> DataFrame | None:
    """(_phrase, _value) of a phrase table, one row a lower-cased phrase; None where it is empty."""
    if df.isEmpty():
        return None
    return _broadcast_if_small(
        df.groupBy(F.lower(key).alias("_phrase")).agg(F.max(F.col(value).cast("double")).alias("_value")), "_phrase")


def _look_up(hits: DataFrame, phrases: DataFrame, parts: tuple[str, ...], out: str) -> DataFrame:
    """Add the value of the phrase that the columns ``parts`` make, NULL where there is none."""
    seq = F.concat_ws(" ", *[F.col(p) for p in parts])
    return hits.join(phrases.withColumnRenamed("_value", out), seq == F.col("_phrase"), "left").drop("_phrase")


def _full_hits(texts: DataFrame, keys: list[str], text_col: str,
               res: SentimentResources) -> DataFrame:
    """Per-hit final valence (V2-V6) for every lexicon hit of every text."""
    staged = texts.select(*keys, _tokens(F.col(text_col)).alias("toks"))
    # Context arrays are the token arrays shifted by k, built once per text.
    # No lambda refers to an outer array: an inlined outer array inside a
    # per-element lambda would be recomputed per element (quadratic per text).
    n = F.size("toks")
    staged = staged.select(
        *keys, "toks", *[_shift("toks", k, n, "string").alias(f"t{i}") for i, k in enumerate((1, 2, 3, -1, -2))],
        # Per-text scalars are computed before the explode, so the Generate
        # carries only scalars, never the arrays, into each output row.
        (F.size(F.filter("toks", _is_upper)).between(1, n - 1)).alias("cap_diff"),
        (F.array_position(F.transform("toks", F.lower), res.contrast) - 1).alias("but_pos"))
    zipped = F.arrays_zip(F.col("toks").alias("t"), *[f"t{i}" for i in range(5)])
    exploded = (staged.select(*keys, "cap_diff", "but_pos", F.posexplode(zipped).alias("pos", "c"))
                .select(*keys, "cap_diff", "but_pos", "pos", F.lower("c.t").alias("lw"), "c.*"))

    vocab = _broadcast_if_small(vocabulary(res), "term")
    scoring = (
        vocab.where(F.col("valence").isNotNull() & F.col("booster").isNull())
        .select(F.col("term").alias("lw"), F.col("valence").alias("v0")))
    context = {"up": _is_upper(F.col("t"))}
    for i, k in enumerate(("p1", "p2", "p3", "n1", "n2")):
        context[k] = F.lower(f"t{i}")
        if k[0] == "p":
            context[f"u{k}"] = _is_upper(F.col(f"t{i}"))
    hits = exploded.join(scoring, "lw").withColumns(context)
    hits = hits.where(~((F.col("lw") == "kind") & F.coalesce(F.col("n1") == "of", F.lit(False))))
    for k in ("p1", "p2", "p3", "n1"):
        side = (vocab.select(
            F.col("term").alias(k), F.col("valence").isNotNull().alias(f"{k}_lex"),
            F.col("booster").alias(f"{k}_boost"), F.col("is_neg").alias(f"{k}_neg")))
        hits = hits.join(side, k, "left")

    col = F.col
    lex = {k: F.coalesce(col(f"{k}_lex"), F.lit(False)) for k in ("p1", "p2", "p3", "n1")}
    cap = col("cap_diff")
    p1, p2, p3 = col("p1"), col("p2"), col("p3")

    # Each rule step becomes its own column so later steps reference an
    # attribute, not a copy of the whole expression tree (which would grow
    # exponentially and overflow code generation).
    v0 = col("v0")
    v = col("_v")
    # "no" directly before a lexicon word loses its own valence
    hits = hits.withColumn("_v", F.when((col("lw") == "no") & col("n1").isNotNull() & lex["n1"],
                                        F.lit(0.0)).otherwise(v0))
    # "no" within the three words before (or "no ... or/nor")
    no_before = ((p1 == "no") | (p2 == "no") | ((p3 == "no") & p1.isin("or", "nor")))
    hits = hits.withColumn("_v", F.when(F.coalesce(no_before, F.lit(False)), v0 * N_SCALAR).otherwise(v))
    # V3 all-caps emphasis
    hits = hits.withColumn("_v", F.when(col("up") & cap, F.when(v > 0, v + C_INCR).otherwise(v - C_INCR))
                           .otherwise(v))

    idioms = _phrases(res.idioms, "phrase", "valence")
    ngram_boosters = _phrases(res.boosters.where(F.col("term").contains(" ")), "term", "scalar")

    # V4 boosters + V5 negation at distances 1, 2, 3 (booster first, then negation)
    for k, damp in ((1, 1.0), (2, 0.95), (3, 0.9)):
        pk = col(f"p{k}")
        gate = pk.isNotNull() & ~lex[f"p{k}"]
        boost = col(f"p{k}_boost")
        s = F.when(boost.isNotNull(),
                   F.when(v < 0, -boost).otherwise(boost)
                   + F.when(col(f"up{k}") & cap,
                            F.when(v > 0, F.lit(C_INCR)).otherwise(F.lit(-C_INCR))).otherwise(0.0)
                   ).otherwise(0.0) * damp
        hits = hits.withColumn("_w", v + s)
        w = col("_w")
        neg_k = _negated(pk, col(f"p{k}_neg"))
        if k == 1:
            w2 = F.when(neg_k, w * N_SCALAR).otherwise(w)
        elif k == 2:
            w2 = (F.when((p2 == "never") & p1.isin("so", "this"), w * 1.25)
                  .when((p2 == "without") & (p1 == "doubt"), w)
                  .when(neg_k, w * N_SCALAR).otherwise(w))
        else:
            w2 = (F.when(((p3 == "never") & p2.isin("so", "this")) | p1.isin("so", "this"), w * 1.5)
                  .when((p3 == "without") & ((p2 == "doubt") | (p1 == "doubt")), w)
                  .when(neg_k, w * N_SCALAR).otherwise(w))
        hits = hits.withColumn("_w", w2)
        if k == 3:
            hits = _idioms(hits, idioms, ngram_boosters)
        hits = hits.withColumn("_v", F.when(gate, w).otherwise(v))
    # "least" rule
    least = ((p1 == "least") & ~lex["p1"] & (p2.isNull() | ~p2.isin("at", "very")))
    hits = hits.withColumn("_v", F.when(F.coalesce(least, F.lit(False)), v * N_SCALAR).otherwise(v))
    # V6 contrast word: before x0.5, after x1.5
    bp, pos = col("but_pos"), col("pos")
    mult = F.when(bp < 0, 1.0).when(pos < bp, 0.5).when(pos > bp, 1.5).otherwise(1.0)
    return hits.select(*keys, (v * mult).alias("s"))


def _idioms(hits: DataFrame, idioms: DataFrame | None, ngram_boosters: DataFrame | None) -> DataFrame:
    """Phrase rules at distance 3: an idiom around the word replaces its valence. Phrases are joined,
    so their tables may have any size."""
    col = F.col
    w = col("_w")
    if idioms is not None:
        # the first of the five sequences up to the word that is an idiom wins, then those after it
        before = (("p1", "lw"), ("p2", "p1", "lw"), ("p2", "p1"), ("p3", "p2", "p1"), ("p3", "p2"))
        after = (("lw", "n1"), ("lw", "n1", "n2"))
        for i, parts in enumerate(before + after):
            hits = _look_up(hits, idioms, parts, f"_i{i}")
        hits = hits.withColumn("_w", F.coalesce(*[col(f"_i{i}") for i in range(5)], w))
        hits = hits.withColumn("_w", F.when(col("n1").isNotNull(), F.coalesce(col("_i5"), w)).otherwise(w))
        hits = hits.withColumn("_w", F.when(col("n2").isNotNull(), F.coalesce(col("_i6"), w)).otherwise(w))
        hits = hits.drop(*[f"_i{i}" for i in range(7)])
    if ngram_boosters is not None:
        for i, parts in enumerate((("p3", "p2", "p1"), ("p3", "p2"), ("p2", "p1"))):
            hits = _look_up(hits, ngram_boosters, parts, f"_b{i}")
        add = sum(F.coalesce(col(f"_b{i}"), F.lit(0.0)) for i in range(3))
        hits = hits.withColumn("_w", w + add).drop("_b0", "_b1", "_b2")
    return hits


def _finish_full(base: DataFrame, agg: DataFrame, keys: list[str]) -> DataFrame:
    """V7-V10 on per-review sums joined to the review rows."""
    col = F.col
    j = base.join(agg, keys, "left")
    sum_s = F.coalesce(col("_sum_s"), F.lit(0.0))
    pos_sum = F.coalesce(col("_pos_sum"), F.lit(0.0))
    neg_sum = F.coalesce(col("_neg_sum"), F.lit(0.0))
    nz = F.coalesce(col("_nz"), F.lit(0))
    punct = col("_punct")
    s2 = F.when(sum_s > 0, sum_s + punct).when(sum_s < 0, sum_s - punct).otherwise(sum_s)
    comp = s2 / F.sqrt(s2 * s2 + NORMALIZE_ALPHA)
    comp = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), comp))
    p2 = F.when(pos_sum > F.abs(neg_sum), pos_sum + punct).otherwise(pos_sum)
    n2 = F.when(pos_sum < F.abs(neg_sum), neg_sum - punct).otherwise(neg_sum)
    neu = col("_ntok") - nz
    total = p2 + F.abs(n2) + neu
    has = col("_ntok") > 0
    out = j.select(
        *[c for c in base.columns if not c.startswith("_")],
        F.when(has, F.bround(comp, 4)).otherwise(0.0).alias("compound"),
        F.when(has, F.bround(F.abs(p2 / total), 3)).otherwise(0.0).alias("pos_score"),
        F.when(has, F.bround(F.abs(n2 / total), 3)).otherwise(0.0).alias("neg_score"),
        F.when(has, F.bround(F.abs(neu / total), 3)).otherwise(0.0).alias("neu_score"),
    )
    return out.withColumn("sentiment", C.sentiment_label("compound"))


def score_full(df: DataFrame, keys: list[str], text_col: str,
               res: SentimentResources) -> DataFrame:
    """Full rule set (V1-V10). ``keys`` must identify a row of ``df``."""
    texts = df.select(*keys, text_col)
    hits = _full_hits(texts, keys, text_col, res)
    agg = hits.groupBy(*keys).agg(
        F.sum("s").alias("_sum_s"),
        F.sum(F.when(F.col("s") > 0, F.col("s") + 1.0)).alias("_pos_sum"),
        F.sum(F.when(F.col("s") < 0, F.col("s") - 1.0)).alias("_neg_sum"),
        F.count(F.when(F.col("s") != 0, 1)).alias("_nz"))
    text = F.col(text_col)
    base = df.select("*", F.size(_raw_tokens(text)).alias("_ntok"),
                     _punct_amplifier(text).alias("_punct"))
    return _finish_full(base, agg, keys)


def _half_even_ratio(num: Column, den: Column, digits: int) -> Column:
    """round(num/den, digits), half-even, exact for non-negative integers."""
    scale = 10 ** digits
    n = num.cast("long") * scale
    d = den.cast("long")
    r = n % d
    q = ((n - r) / d).cast("long")
    up = F.when(r * 2 > d, 1).when((r * 2 == d) & (q % 2 == 1), 1).otherwise(0)
    return (q + up) / F.lit(float(scale))


def score_basic(df: DataFrame, keys: list[str], text_col: str,
                res: SentimentResources) -> DataFrame:
    """Lexicon sum only: tokens ``[a-z]+`` of the lower-cased text, no rules.

    Valences are summed as integer tenths so sums are exact in any order.
    """
    toks = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[a-z]+"), 0)
    lex10 = (res.lexicon.select(
        F.lower("term").alias("term"), F.round(F.col("valence") * 10).cast("long").alias("v10")))
    hits = df.select(*keys, F.explode(toks).alias("term")).join(lex10, "term")
    agg = hits.groupBy(*keys).agg(
        F.sum("v10").alias("_s10"),
        F.sum(F.when(F.col("v10") > 0, F.col("v10") + 10)).alias("_pos10"),
        F.sum(F.when(F.col("v10") < 0, 10 - F.col("v10"))).alias("_neg10"),
        F.count(F.when(F.col("v10") != 0, 1)).alias("_nz"))
    base = df.select("*", F.size(toks).alias("_ntok"))
    col = F.col
    j = base.join(agg, keys, "left")
    s = F.coalesce(col("_s10"), F.lit(0)) / F.lit(10.0)
    pos10 = F.coalesce(col("_pos10"), F.lit(0))
    neg10 = F.coalesce(col("_neg10"), F.lit(0))
    neu10 = (col("_ntok") - F.coalesce(col("_nz"), F.lit(0))) * 10
    tot10 = pos10 + neg10 + neu10
    has = col("_ntok") > 0
    out = j.select(
        *[c for c in base.columns if not c.startswith("_")],
        F.when(has, F.bround(s / F.sqrt(s * s + NORMALIZE_ALPHA), 4)).otherwise(0.0).alias("compound"),
        F.when(has, _half_even_ratio(pos10, tot10, 3)).otherwise(0.0).alias("pos_score"),
        F.when(has, _half_even_ratio(neg10, tot10, 3)).otherwise(0.0).alias("neg_score"),
        F.when(has, _half_even_ratio(neu10, tot10, 3)).otherwise(0.0).alias("neu_score"),
    )
    return out.withColumn("sentiment", C.sentiment_label("compound"))


REVIEW_KEY = ["product_id", "review_pos"]


def score_reviews(reviews: DataFrame, res: SentimentResources, mode: str = "full") -> DataFrame:
    """scored_reviews = reviews + compound, pos/neg/neu shares, label."""
    fn = score_full if mode == "full" else score_basic
    return fn(reviews, REVIEW_KEY, "review_text", res)
