"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent n-grams (1 to 3 letters, words
padded with a blank on each side), in order. A document's own profile is
compared with every language's: the distance is the sum of how far each of
its n-grams is out of place, and PROFILE for one that the language lacks. The
least distance wins, ties by the smaller language name.

The profiles are fitted on a sample of about ``per_language`` texts of each
language, chosen by the hash of the text; this bound is a parameter. Every
document is judged on its whole text.

An n-gram is one 63-bit integer, 21 bits a letter, so counting is sorting.

Edge cases: a null text, or one without a letter, is ``und`` with score 0. A
table without a learnable language predicts ``und`` everywhere. Ties in
frequency are ordered by the n-gram's code points. Repeated rows are judged
alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_enough

PROFILE = 400
PER_LANGUAGE = 1000
BLANK = 0x20
UND = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngrams(text: str | None) -> np.ndarray:
    """All 1- to 3-grams of a text's lower-cased words, one integer each (blank alone left out)."""
    cps = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[cps]
    if not letter.any():
        return np.empty(0, np.int64)
    c = np.concatenate([[BLANK], np.where(letter, cps, BLANK), [BLANK]]).astype(np.int64)
    c = c[np.concatenate([[True], (c[1:] != BLANK) | (c[:-1] != BLANK)])]  # one blank between words
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.concatenate([c[c != BLANK], two, three[c[1:-1] != BLANK]])


def profile(grams: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The ``size`` most frequent n-grams, most frequent first, ties by the n-gram."""
    values, counts = np.unique(grams, return_counts=True)
    if len(values) > size:  # all that could be among the first, then their order
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        values, counts = values[counts >= least], counts[counts >= least]
    return values[np.lexsort((values, -counts))][:size]


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, usable: Column, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, text): about ``per_language`` distinct usable texts of each language, all if it has fewer.

    A text is taken when its hash lies in the lowest per_language / distinct
    texts of the hash range; copies of a text count once, null texts never.
    """
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.xxhash64("text").alias("_h"))
    share = (rows.select("lang", "_h").distinct().groupBy("lang")
             .agg((F.lit(float(per_language)) / F.count(F.lit(1))).alias("_share")))
    side = F.broadcast(share) if small_enough(share.count(), 64) else share  # a row a language
    taken = rows.join(side, "lang").where(F.col("_h") / 2.0 ** 64 + 0.5 < F.col("_share"))
    return taken.groupBy("lang", "_h").agg(F.first("text").alias("text")).select("lang", "text")


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs = b.column("lang").to_pylist()
        texts = b.column("text").to_pylist()
        for lang in sorted(set(langs)):
            values, counts = np.unique(np.concatenate(
                [ngrams(t) for t, x in zip(texts, langs, strict=True) if x == lang]), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(values), pa.string()), pa.array(values, pa.int64()),
                 pa.array(counts, pa.int64())], ["lang", "gram", "n"])


def language_profiles(docs: DataFrame, usable: Column, per_language: int = PER_LANGUAGE,
                      size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank): the first ``size`` n-grams of each language, rank from 0."""
    counts = (training_rows(docs, usable, per_language).mapInArrow(_gram_counts, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return (counts.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < size)
            .select("lang", "gram", "rank"))


class Judge:
    """Out-of-place distances of a text to all profiles at once."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.langs = sorted({r[0] for r in rows})
        self.size = size
        self.grams = np.unique(np.array([r[1] for r in rows], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)
        for lang, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, gram), self.langs.index(lang)] = rank

    def __call__(self, text: str | None) -> tuple[str, float]:
        grams = ngrams(text)
        if not len(grams) or not self.langs:
            return UND, 0.0
        own = profile(grams, self.size)
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        at[self.grams[at] != own] = len(self.grams)
        ranks = self.ranks[at]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(apart))
        return self.langs[best], float(1.0 - apart[best] / (self.size * len(own)))


def _predict(rows: list[tuple[str, int, int]], size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(rows, size)
        for b in batches:
            got = [judge(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
    return run


def predict_languages(docs: DataFrame, per_language: int = PER_LANGUAGE, size: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred and score (1 - distance / greatest distance) of every document.

    Learns from rows that aren't held out. The profiles, ``size`` rows for
    each language, are the model that goes to every task; their number is
    checked against the broadcast bound.
    """
    model = language_profiles(docs, ~held_out(), per_language, size)
    rows = [tuple(r) for r in model.collect()]  # size rows for each distinct language
    if not small_enough(len(rows), 64):
        raise ValueError(f"{len(rows)} profile rows: lang has too many values to be a language column")
    kind = dict(docs.dtypes)["doc_id"]
    return (docs.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out"))
            .mapInArrow(_predict(rows, size), f"doc_id {kind}, held_out boolean, lang_pred string, score double"))
