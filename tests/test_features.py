"""Exact median, splits, metrics, kNN and scoreboard windows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from sentiscope.operators import features as FE
from sentiscope.operators import neighbors as NB
from sentiscope.operators import scoreboard as SB
from sentiscope.operators.evaluate import classification_metrics


def test_exact_median_interpolates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert FE.exact_median(df, "x") == 2.5


def test_exact_median_refines_buckets(spark):
    vals = [float(v) for v in np.random.default_rng(1).normal(size=501)] + [7.0] * 200
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert FE.exact_median(df, "x") == pytest.approx(float(np.median(vals)))


def test_metrics_zero_division(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (2.0, 2.0), (2.0, 2.0)], "label double, prediction double")
    m = classification_metrics(df).first()
    assert m["accuracy"] == 0.75
    assert m["precision"] == pytest.approx(0.25 * 0.5 + 0.25 * 0 + 0.5 * 1.0)


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(40, 6))
    labels = rng.integers(0, 3, size=40)
    df = spark.createDataFrame([(i, [float(x) for x in v], int(y)) for i, (v, y) in enumerate(zip(vecs, labels))],
                               "id long, v array<double>, y int")
    got = {(r["id"], r["rank"]): r["nbr_id"] for r in NB.knn(df, df, "id", "v", "y", 3).collect()}
    u = vecs / np.linalg.norm(vecs, axis=1)[:, None]
    sim = np.round(u @ u.T, 6)
    np.fill_diagonal(sim, -np.inf)
    for i in range(40):
        order = sorted(range(40), key=lambda j: (-sim[i, j], j))[:3]
        assert [got[(i, r + 1)] for r in range(3)] == order


def test_scoreboard_windows(spark):
    rows = [("a", 0, "m1", 0, 0.5), ("a", 0, "m2", 1, 0.7), ("a", 0, "m3", 2, 0.7),
            ("b", 1, "m1", 0, 0.9), ("b", 1, "m2", 1, 0.1), ("c", 2, "m9", 0, 0.9), ("c", 2, "m1", 1, None)]
    r = spark.createDataFrame(rows, "target string, target_order int, model string, model_order int, score double")
    best = {x["target"]: x["model"] for x in SB.best_per_target(r).collect()}
    assert best == {"a": "m2", "b": "m1", "c": "m9"}
    f = {(x["target"], x["model"]): x for x in SB.score_features(r).collect()}
    assert f[("a", "m2")]["step"] == pytest.approx(0.2)
    assert f[("a", "m1")]["share_offset"] == 0.0
    assert sum(f[("a", m)]["pct"] for m in ("m1", "m2", "m3")) == 100
    sb = SB.scoreboard(r).first()
    assert sb["mean_best_score"] == pytest.approx(2.5 / 3)
    # ties: the first target's winner, and the first target with the best score
    assert sb["best_target"] == "b" and sb["most_frequent_winner"] == "m2" and sb["winner_count"] == 1
    seen = {x["model"]: x["first_seen"] for x in SB.score_matrix(r, ["a", "b", "c"]).collect()}
    assert seen == {"m1": 1, "m2": 2, "m3": 3, "m9": 4}


def test_split_is_row_local(spark):
    df = spark.range(1000).withColumnRenamed("id", "product_id")
    s = FE.split_flag(df)
    frac = s.agg(F.avg(F.col("is_test").cast("double"))).first()[0]
    assert 0.15 < frac < 0.25


def test_medians_match_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b) if i % 3 else None, float(c), None) for i, (a, b, c) in
            enumerate(zip(rng.integers(0, 20, 302), rng.normal(size=302), rng.normal(size=302) * 1e300))]
    rows += [(float("nan"), 1.0, float("inf"), None), (3.0, 2.0, float("-inf"), float("nan"))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = FE.exact_medians(df, ["a", "b", "c", "d"])
    for i, c in enumerate("abc"):
        own = [r[i] for r in rows if r[i] is not None and not np.isnan(r[i])]
        assert got[c] == pytest.approx(float(np.median(own))), c
    assert got["d"] is None


def test_median_ends_at_infinity_and_extremes(spark):
    inf = float("inf")
    for xs in ([1.0, inf, inf], [-inf, -inf, 2.0, 3.0, 4.0], [-1.7e308, 1.7e308, 5e-324], [float(i) for i in range(40)] + [inf]):
        df = spark.createDataFrame([(x,) for x in xs], "x double")
        assert FE.exact_median(df, "x") == float(np.median(xs))


def test_median_of_a_million_distinct_values(spark):
    df = spark.range(1_200_001).selectExpr("double(id) * double(id) as x")
    assert FE.exact_median(df, "x") == 600_000.0 ** 2


def test_hash_takes_any_id(spark):
    df = spark.createDataFrame([(4_000_000_000,), (-5,), (2 ** 62,), (7,)], "product_id long")
    got = [r["h"] for r in df.select(FE.row_hash().alias("h")).collect()]
    assert all(0 <= h < FE.HASH_MOD for h in got) and len(set(got)) == 4


def test_stratified_split_is_exact(spark):
    rng = np.random.default_rng(3)
    y = np.concatenate([np.zeros(5000), np.ones(7), np.full(1, 2), np.full(333, 3)])
    rng.shuffle(y)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)] + [(9_000_000_000, None)], "product_id long, y double")
    s = FE.split_stratified(df, "y").toPandas()
    assert len(s) == len(y) + 1
    for v in (0, 1, 2, 3):
        own = s[s.y == v]
        assert own.is_test.sum() == (2 * len(own) + 5) // 10
    h = {r["product_id"]: r["h"] for r in df.select("product_id", FE.row_hash().alias("h")).collect()}
    big = s[s.y == 0]
    assert max(h[i] for i in big[big.is_test].product_id) <= min(h[i] for i in big[~big.is_test].product_id)


def test_singular_vectors_match_numpy(spark):
    rng = np.random.default_rng(8)
    m = rng.normal(size=(60, 5)) * np.array([9, 5, 3, 2, 1])
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "id long, v array<double>").repartition(4)
    got = NB.right_singular_vectors(df, "v", 3)
    want = np.linalg.svd(m)[2][:3].T
    assert np.allclose(np.abs((got * want).sum(axis=0)), 1)
    low = {r["id"]: r["v"] for r in NB.truncated_svd(df, "id", "v", 3).collect()}
    assert np.allclose([low[i] for i in range(60)], m @ got)


@pytest.mark.parametrize("seed", range(3))
def test_top_terms_of_words_and_pairs_match_plain_counts(spark, seed):
    import random
    from collections import Counter

    from sentiscope.operators.features import term_lists, top_terms

    rnd = random.Random(seed)
    words = [f"w{chr(97 + i)}" for i in range(12)]
    texts = [" ".join(rnd.choices(words, weights=range(1, 13), k=rnd.randint(0, 30))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    lists = term_lists(df, "id", "text", [], 2)
    count = Counter()
    for t in texts:
        w = t.split()
        count.update(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    for most in (3, 9, 12, 40, 500):
        want = sorted(count, key=lambda t: (-count[t], t))[:most]
        assert sorted(r["term"] for r in top_terms(lists, "_t", most, True).collect()) == sorted(want)


def test_only_pairs_of_frequent_words_are_grouped(spark, monkeypatch):
    from sentiscope.operators import features as fe

    seen = {}
    whole = fe.materialize
    monkeypatch.setattr(fe, "materialize", lambda df, name: seen.setdefault(name, whole(df, name)))
    df = spark.createDataFrame([(i, f"common often rare{i}x seldom{i}y") for i in range(50)], "id long, text string")
    top = fe.top_terms(fe.term_lists(df, "id", "text", [], 2), "_t", 2, True).collect()
    assert sorted(r["term"] for r in top) == ["common", "common often"]
    assert sorted(r["term"] for r in seen["terms-frequent"].collect()) == ["common", "often"]
