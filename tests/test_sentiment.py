"""Rule-by-rule checks of the scorer with a five-word lexicon, against a plain
per-text implementation of the same rules."""
import math

import pytest

from sentiscope.functions.lexicons import _tables
from sentiscope.operators.sentiment import score_basic, score_full

LEX = {"good": 2.0, "bad": -2.0, "great": 3.0, "no": -1.2, "hate": -2.5}
BOOST = {"very": 0.293, "slightly": -0.293}
NEG = ["not", "never", "without"]


def res(spark):
    return _tables(spark, LEX, BOOST, NEG, {}, "but")


def scores(spark, texts, fn=score_full):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    out = fn(df, ["id"], "text", res(spark)).orderBy("id").collect()
    return [r["compound"] for r in out]


def norm(s):
    return round(s / math.sqrt(s * s + 15), 4)


@pytest.mark.parametrize("text,expected", [
    ("good", norm(2.0)),
    ("not good", norm(2.0 * -0.74)),
    ("very good", norm(2.0 + 0.293)),
    ("good but bad", norm(2.0 * 0.5 - 2.0 * 1.5)),
    ("GOOD product here", norm(2.0 + 0.733)),
    ("good!", norm(2.0 + 0.292)),
    ("", 0.0),
    ("nothing here", 0.0),
])
def test_rules(spark, text, expected):
    assert scores(spark, [text])[0] == pytest.approx(expected, abs=1e-4)


def test_booster_sign_follows_valence(spark):
    assert scores(spark, ["very bad"])[0] == pytest.approx(norm(-2.0 - 0.293), abs=1e-4)


def test_compound_bounded_and_labels_partition(spark):
    texts = ["good " * 50, "bad " * 50, "meh", "good bad", "NOT GOOD!!!"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    out = score_full(df, ["id"], "text", res(spark)).collect()
    assert len(out) == len(texts)
    for r in out:
        assert -1.0 <= r["compound"] <= 1.0
        assert r["sentiment"] in ("Positive", "Negative", "Neutral")
        if r["compound"] != 0 or r["neu_score"]:
            assert r["pos_score"] + r["neg_score"] + r["neu_score"] == pytest.approx(1.0, abs=2e-3)


def test_basic_sums_tenths(spark):
    assert scores(spark, ["good bad great"], score_basic)[0] == norm(3.0)


def test_idioms_and_phrase_boosters(spark):
    """Values worked out by hand from the phrase rules."""
    r = _tables(spark, {"death": -2.9, "good": 1.9, "hit": 0.5}, {"very": 0.293, "sort of": -0.293}, ["not"],
                {"kiss of death": -1.5, "hit the mark": 2.0}, "but")
    texts = ["the kiss of death here", "a slow sad death here", "it sort of good now", "then we now hit the mark there"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = [x["compound"] for x in score_full(df, ["id"], "text", r).orderBy("id").collect()]
    want = [v / math.sqrt(v * v + 15) for v in (-1.5, -2.9, 1.9 - 0.293, 2.0)]
    assert got == [pytest.approx(w, abs=6e-5) for w in want]


def test_tokens_meet_small_resource_tables_by_broadcast(spark):
    texts = spark.createDataFrame([(1, "not good")], "id long, text string")
    phrases = _tables(spark, LEX, BOOST | {"kind of": -0.293}, NEG, {"the bomb": 3.0}, "but")
    for r, joins in ((res(spark), 5), (phrases, 15)):
        plan = score_full(texts, ["id"], "text", r)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") >= joins
        assert plan.count("SortMergeJoin") <= 1  # the sums' join with the reviews


def test_punctuation_inside_words_and_short_rests_stay(spark):
    texts = ["!!good??", "(good)", "a!", "go-od", "[\\good^]`{|}~", " good bad"]
    assert scores(spark, texts)[1:5] == [norm(2.0), 0.0, 0.0, norm(2.0)]
    assert scores(spark, texts)[5] == 0.0
