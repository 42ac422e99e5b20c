"""Flattening (X1) and filters."""
from sentiscope.operators.filters import FilterSpec, apply_filters
from sentiscope.operators.reviews import clean_products, flatten_reviews

SCHEMA = ("product_id long, title string, price string, rating string, total_reviews string, "
          "ram string, form_factor string, manufacturer string, os string, colour string, "
          "reviews string, reviews_rating string")


def products(spark, rows):
    return clean_products(spark.createDataFrame(rows, SCHEMA))


def row(pid, reviews, ratings, price="₹1,000", rating="4.0 out of 5"):
    return (pid, "t", price, rating, "10", "4 GB", "bar", "B", "Android", "red", reviews, ratings)


def test_zip_truncates_to_shorter(spark):
    p = products(spark, [row(1, "a||b||c", "4 out of 5||5 out of 5")])
    r = flatten_reviews(p).orderBy("review_pos").collect()
    assert [x["review_text"] for x in r] == ["a", "b"]
    assert [x["star_rating"] for x in r] == [4.0, 5.0]


def test_null_ratings_keep_first_review(spark):
    p = products(spark, [row(1, "a||b||c", None)])
    r = flatten_reviews(p).collect()
    assert len(r) == 1 and r[0]["star_rating"] is None


def test_blank_and_nan_texts_dropped(spark):
    p = products(spark, [row(1, " \t ||NaN||ok", "1||2||3")])
    r = flatten_reviews(p).collect()
    assert [x["review_text"] for x in r] == ["ok"]


def test_filters_match_semi_join(spark):
    p = products(spark, [row(1, "a||b", "1||2", price="₹500"), row(2, "c", "3", price="₹5,000"),
                         row(3, "d", "4", price=None)])
    r = flatten_reviews(p)
    spec = FilterSpec(price_range=(0, 1000))
    d1, r1 = apply_filters(p, r, spec)
    d2, r2 = apply_filters(p, r, spec, semi_join=True)
    key = lambda df: sorted((x["product_id"], x["review_pos"]) for x in df.collect())
    assert key(r1) == key(r2) == [(1, 0), (1, 1), (3, 0)]


def test_flatten_time_grows_with_the_reviews(spark):
    import time

    def took(n):
        df = spark.createDataFrame([(1, "||".join(["some review text here"] * n), "||".join(["4.0 out of 5 stars"] * n))],
                                   "product_id long, reviews string, reviews_rating string")
        for c in ("title", "manufacturer", "category", "os", "colour"):
            df = df.selectExpr("*", f"'x' as {c}")
        df = df.selectExpr("*", "1.0D as price_clean", "1.0D as rating_clean", "1.0D as ram_gb")
        t = time.perf_counter()
        assert flatten_reviews(df).count() == n
        return time.perf_counter() - t

    took(1000)
    small, large = min(took(2000) for _ in range(2)), min(took(16_000) for _ in range(2))
    assert large < 16 * small + 1


def test_packed_reviews_match_a_plain_join_and_shuffle_texts_once(spark, tmp_path):
    from sentiscope.sources.testdata import packed_reviews

    docs = [(0, "b"), (1, "a|x"), (1, "a|x"), (1, None), (4, "z"), (6, "q"), (None, "n"), (None, "m"), (14, "")]
    labels = [(0, 1), (1, 0), (1, 1), (1, None), (6, 0), (6, 0), (None, 1), (99, 1)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    star = {1: "5.0 out of 5 stars", 0: "2.0 out of 5 stars", None: ""}
    items = {}
    for d, t in docs:
        own = [q for e, q in labels if d is not None and e == d] or [None]
        t = None if t is None else t.replace("|", " ")
        items.setdefault(None if d is None else d // 5, []).extend((d, t, star[q]) for q in own)
    want = []
    for k, v in items.items():
        v.sort(key=lambda x: (x[0] or 0, x[1] is not None, x[1] or "", x[2]))
        want.append((k, "||".join(t for _, t, _ in v if t is not None), "||".join(s for _, _, s in v)))
    packed = packed_reviews(spark, str(tmp_path))
    assert sorted(map(tuple, packed.collect()), key=str) == sorted(want, key=str)
    logical = packed._jdf.queryExecution().optimizedPlan().toString()
    assert logical.count("Join") == 1 and logical.index("Join") < logical.index("Aggregate")  # texts are dealt out by product alone
