"""Sentiment resource tables: lexicon, boosters, negations, idioms.

The scorer reads these as DataFrames, so a full lexicon can be supplied as a
table (``term STRING, valence DOUBLE``). The repo ships only:

* the fixture lexicon used by tests and the oracle (FIXTURES.md §4), and
* the rule-word lists of the published VADER rule set (Hutto & Gilbert, 2014),
  which are small fixed lists, and a short hand-written sample lexicon.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: fixture lexicon (FIXTURES.md §4), valences made up for testing ---
FIXTURE_LEXICON = {
    "this": 2.0, "with": 1.5, "at": 0.9, "be": 1.1,
    "was": -1.2, "from": -1.8, "by": -2.1, "are": -0.7,
}
FIXTURE_BOOSTERS = {"as": 0.293}
FIXTURE_NEGATIONS = ["for"]
FIXTURE_CONTRAST = "that"

# --- fixed values: rule constants of the published rule set ---
B_INCR = 0.293
B_DECR = -0.293
C_INCR = 0.733
N_SCALAR = -0.74
NORMALIZE_ALPHA = 15.0
EXCLAIM_STEP, EXCLAIM_MAX = 0.292, 4
QUESTION_STEP, QUESTION_MAX_AMP = 0.18, 0.96

# --- fixed values: negation words of the published rule set ---
VADER_NEGATIONS = [
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt",
    "ain't", "aren't", "can't", "couldn't", "daren't", "didn't", "doesn't",
    "dont", "hadnt", "hasnt", "havent", "isnt", "mightnt", "mustnt", "neither",
    "don't", "hadn't", "hasn't", "haven't", "isn't", "mightn't", "mustn't",
    "neednt", "needn't", "never", "none", "nope", "nor", "not", "nothing", "nowhere",
    "oughtnt", "shant", "shouldnt", "uhuh", "wasnt", "werent",
    "oughtn't", "shan't", "shouldn't", "uh-uh", "wasn't", "weren't",
    "without", "wont", "wouldnt", "won't", "wouldn't", "rarely", "seldom", "despite",
]

# --- fixed values: booster / dampener words of the published rule set ---
VADER_BOOSTERS = {
    "absolutely": B_INCR, "amazingly": B_INCR, "awfully": B_INCR,
    "completely": B_INCR, "considerable": B_INCR, "considerably": B_INCR,
    "decidedly": B_INCR, "deeply": B_INCR, "effing": B_INCR, "enormous": B_INCR, "enormously": B_INCR,
    "entirely": B_INCR, "especially": B_INCR, "exceptional": B_INCR, "exceptionally": B_INCR,
    "extreme": B_INCR, "extremely": B_INCR,
    "fabulously": B_INCR, "flipping": B_INCR, "flippin": B_INCR, "frackin": B_INCR, "fracking": B_INCR,
    "fricking": B_INCR, "frickin": B_INCR, "frigging": B_INCR, "friggin": B_INCR, "fully": B_INCR,
    "fuckin": B_INCR, "fucking": B_INCR, "fuggin": B_INCR, "fugging": B_INCR,
    "greatly": B_INCR, "hella": B_INCR, "highly": B_INCR, "hugely": B_INCR,
    "incredible": B_INCR, "incredibly": B_INCR, "intensely": B_INCR,
    "major": B_INCR, "majorly": B_INCR, "more": B_INCR, "most": B_INCR, "particularly": B_INCR,
    "purely": B_INCR, "quite": B_INCR, "really": B_INCR, "remarkably": B_INCR,
    "so": B_INCR, "substantially": B_INCR,
    "thoroughly": B_INCR, "total": B_INCR, "totally": B_INCR, "tremendous": B_INCR, "tremendously": B_INCR,
    "uber": B_INCR, "unbelievably": B_INCR, "unusually": B_INCR, "utter": B_INCR, "utterly": B_INCR,
    "very": B_INCR,
    "almost": B_DECR, "barely": B_DECR, "hardly": B_DECR, "just enough": B_DECR,
    "kind of": B_DECR, "kinda": B_DECR, "kindof": B_DECR, "kind-of": B_DECR,
    "less": B_DECR, "little": B_DECR, "marginal": B_DECR, "marginally": B_DECR,
    "occasional": B_DECR, "occasionally": B_DECR, "partly": B_DECR,
    "scarce": B_DECR, "scarcely": B_DECR, "slight": B_DECR, "slightly": B_DECR, "somewhat": B_DECR,
    "sort of": B_DECR, "sorta": B_DECR, "sortof": B_DECR, "sort-of": B_DECR,
}

# --- fixed values: idioms of the published rule set ---
VADER_IDIOMS = {
    "the shit": 3, "the bomb": 3, "bad ass": 1.5, "badass": 1.5, "bus stop": 0.0,
    "yeah right": -2, "kiss of death": -1.5, "to die for": 3,
    "beating heart": 3.1, "broken heart": -2.9,
}

# A short hand-written sample so the library runs without the full lexicon.
# Values are illustrative, not the published ones: supply the full lexicon
# table for faithful scores.
SAMPLE_LEXICON = {
    "good": 1.9, "great": 3.1, "excellent": 2.7, "love": 3.2, "amazing": 2.8,
    "awesome": 3.1, "best": 3.2, "nice": 1.8, "happy": 2.7, "perfect": 2.7,
    "worth": 0.9, "recommend": 1.5, "fast": 0.5, "satisfied": 1.8,
    "bad": -2.5, "poor": -2.1, "terrible": -2.1, "worst": -3.1, "hate": -2.7,
    "broken": -1.6, "slow": -0.9, "disappointed": -1.9, "waste": -1.8,
    "problem": -1.7, "useless": -1.8, "defective": -1.9, "no": -1.2,
}


@dataclass
class SentimentResources:
    """Lexicon tables the scorer joins against.

    lexicon(term, valence), boosters(term, scalar), negations(term),
    idioms(phrase, valence); ``contrast`` is the contrastive conjunction.
    """

    lexicon: DataFrame
    boosters: DataFrame
    negations: DataFrame
    idioms: DataFrame
    contrast: str = "but"


def _tables(spark: SparkSession, lexicon: dict, boosters: dict, negations: list,
            idioms: dict, contrast: str) -> SentimentResources:
    return SentimentResources(
        lexicon=spark.createDataFrame([(k, float(v)) for k, v in lexicon.items()],
                                      "term string, valence double"),
        boosters=spark.createDataFrame([(k, float(v)) for k, v in boosters.items()],
                                       "term string, scalar double"),
        negations=spark.createDataFrame([(k,) for k in negations], "term string"),
        idioms=spark.createDataFrame([(k, float(v)) for k, v in idioms.items()],
                                     "phrase string, valence double"),
        contrast=contrast,
    )


def fixture_resources(spark: SparkSession) -> SentimentResources:
    """FIXTURES.md §4: eight words, booster 'as', negation 'for', contrast 'that'."""
    return _tables(spark, FIXTURE_LEXICON, FIXTURE_BOOSTERS, FIXTURE_NEGATIONS, {},
                   FIXTURE_CONTRAST)


def default_resources(spark: SparkSession, lexicon: DataFrame | None = None) -> SentimentResources:
    """Published rule words + a supplied lexicon table (or the small sample)."""
    res = _tables(spark, SAMPLE_LEXICON, VADER_BOOSTERS, VADER_NEGATIONS, VADER_IDIOMS, "but")
    if lexicon is not None:
        res.lexicon = lexicon.selectExpr("lower(term) AS term", "CAST(valence AS DOUBLE) AS valence")
    return res
