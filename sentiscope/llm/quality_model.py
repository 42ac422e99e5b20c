"""Quality classifier: Bradley-Terry ranking over features of the text.

A document's strength is a linear function of its features. Preference pairs
set a document labelled 1 against one labelled 0; the weights minimise the
logistic loss of the pairs' feature differences (with a small ridge), by
Newton steps. Strengths have no natural zero, so the cut is a quantile of the
training strengths: the share of label 0 among all labels learnt from. The
score is the logistic function of the strength, shifted so that the cut
scores CUT_SCORE.

``train`` learns from every labelled document that isn't held out. Features of
all documents are computed once. Labelled rows are dealt by hash into blocks of
about BLOCK rows, and within a block every row of label 1 meets every row of
label 0; a label too rare to reach each block goes to several. A Newton step is
one pass over the blocks that adds up loss, gradient and Hessian, a row a task.
Means, deviations, the share of label 0 and the cut come from all of these rows.
``fit`` is the same on arrays, with drawn pairs. Every document is scored on its
whole text.

Edge cases: a null or empty text has features like any other (all zero).
Without labels of both kinds there are no pairs: every strength is 0 and
every score CUT_SCORE. Null labels are left out; a document labelled twice
counts twice. Ties in strength share their score. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .quality_rules import STOP_WORDS

PAIRS = 60_000
BLOCK, LEAST = 512, 32  # rows of a block, and rows of each label that it should hold
PRODUCT = 1 << 20  # pairs in memory at a time
SELECT_RANGES = 1024
RIDGE = 1e-2
CUT_SCORE = 0.3
SEED = 7
FEATURES = ["log_words", "word_length", "symbols", "exclamations", "pipes", "capitals", "digits",
            "marks", "distinct", "same_as_last", "repeated_lines", "log_line_words", "stop_words"]

_UPPER = bytes(range(0x41, 0x5B))
_DIGITS = bytes(range(0x30, 0x3A))
_SYMBOLS = b"#*$%&<>"
_MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
_STOPS = frozenset(w.encode() for w in STOP_WORDS) | frozenset(w.capitalize().encode() for w in STOP_WORDS)


def _share(b: bytes, kinds: bytes) -> int:
    return len(b) - len(b.translate(None, kinds))


def features(text: bytes | None) -> list[float]:
    """The FEATURES of a text in UTF-8; all zero for one without words."""
    b = text or b""
    words = b.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = sum(map(len, words))
    lines = [x for x in b.split(b"\n") if x.strip()]
    return [
        np.log1p(n), size / n, _share(b, _SYMBOLS) / n, b.count(b"!") / n, b.count(b"|") / n,
        _share(b, _UPPER) / size, _share(b, _DIGITS) / size, _share(b, _MARKS) / size,
        len(set(words)) / n, sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        sum(map(_STOPS.__contains__, words)) / n,
    ]


class Model:
    """Weights on standardised features, and the shift that puts the cut at CUT_SCORE."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut: float):
        self.mean, self.scale, self.weights, self.cut = mean, scale, weights, cut

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.strength(x) - self.cut + np.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, label: np.ndarray, share_0: float, pairs: int = PAIRS, ridge: float = RIDGE,
        seed: int = SEED) -> Model:
    """Bradley-Terry fit on preference pairs drawn between the two labels."""
    d = len(FEATURES)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(d), np.ones(d), np.zeros(d), 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    diff = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(d)

    def loss(w: np.ndarray) -> float:
        return np.logaddexp(0, -diff @ w).mean() + ridge * (w @ w) / 2

    for _ in range(50):  # Newton with halving, on a strictly convex loss
        p = 1 / (1 + np.exp(np.clip(diff @ w, -500, 500)))
        grad = -diff.T @ p / pairs + ridge * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(d)
        step = np.linalg.solve(hess, grad)
        t = 1.0
        while t > 1e-6 and loss(w - t * step) > loss(w):
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-8:
            break
    s = z @ w
    # the quantile over all labels learnt from: the sample weighs its labels as they are there
    weight = np.where(label == 1, (1 - share_0) / len(good), share_0 / len(bad))
    order = np.argsort(s, kind="stable")
    i = min(int(np.searchsorted(np.cumsum(weight[order]), share_0 - 1e-12)), len(s) - 1)
    j = min(i + 1, len(s) - 1)
    return Model(mean, scale, w, float((s[order[i]] + s[order[j]]) / 2))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [features(t.as_py()) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(x, pa.list_(pa.float64()))],
                                         ["doc_id", "held_out", "x"])


def feature_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, x) of every document, written once."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("binary").alias("text"))
    return materialize(rows.mapInArrow(_features, f"doc_id {kind}, held_out boolean, x array<double>"), "quality-features")


def _matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _packed(mean: np.ndarray, scale: np.ndarray) -> Callable:
    """A block's standardised rows of either label, one array each."""
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        z = np.clip((_matrix(t.column("x").combine_chunks()) - mean) / scale, -8, 8)
        label = t.column("quality").to_numpy()
        return pa.table({k: pa.array([z[label == v].reshape(-1)], pa.list_(pa.float64())) for k, v in (("good", 1), ("bad", 0))})
    return run


def blocks(rows: DataFrame, counts: dict[int, int], mean: np.ndarray, scale: np.ndarray) -> DataFrame:
    """(good, bad): every row of (quality, x) in a block, rows of a rare label in several; written once."""
    n = max(1, -(-(counts[0] + counts[1]) // BLOCK))
    copies = {v: min(n, -(-LEAST * n // counts[v])) for v in (0, 1)}
    salts = F.when(F.col("quality") == 1, F.sequence(F.lit(0), F.lit(copies[1] - 1))).otherwise(F.sequence(F.lit(0), F.lit(copies[0] - 1)))
    dealt = rows.select("quality", "x", F.xxhash64("doc_id", "quality", "x").alias("h"), F.explode(salts).alias("salt"))
    # copies of a row go to blocks that follow each other, so they never share one
    dealt = dealt.select("quality", "x", F.pmod(F.pmod("h", F.lit(n)) + F.col("salt"), F.lit(n)).alias("block"))
    return materialize(dealt.groupBy("block").applyInArrow(_packed(mean, scale), "good array<double>, bad array<double>"), "quality-blocks")


def _sums(w: np.ndarray) -> Callable:
    """Pairs, loss, gradient and Hessian of a task's blocks."""
    d = len(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, loss, grad, hess = 0.0, 0.0, np.zeros(d), np.zeros((d, d))
        for b in batches:
            for good, bad in zip(b.column("good"), b.column("bad")):
                one, zero = (v.values.to_numpy().reshape(-1, d) for v in (good, bad))
                step = max(1, PRODUCT // max(1, len(zero)))
                for at in range(0, len(one), step) if len(zero) else ():
                    z = one[at:at + step]
                    gap = (z @ w)[:, None] - (zero @ w)[None, :]
                    p = 1 / (1 + np.exp(np.clip(gap, -500, 500)))
                    q = p * (1 - p)
                    cross = z.T @ q @ zero
                    pairs += gap.size
                    loss += np.logaddexp(0, -gap).sum()
                    grad -= z.T @ p.sum(axis=1) - zero.T @ p.sum(axis=0)
                    hess += (z.T * q.sum(axis=1)) @ z + (zero.T * q.sum(axis=0)) @ zero - cross - cross.T
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[pairs, loss], grad, hess.reshape(-1)])], pa.list_(pa.float64()))], ["v"])
    return run


def fit_blocks(packed: DataFrame, ridge: float = RIDGE) -> np.ndarray:
    """Weights that minimise the mean logistic loss of all pairs of the blocks: Newton with halving."""
    d = len(FEATURES)

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        v = np.sum([r["v"] for r in packed.mapInArrow(_sums(w), "v array<double>").collect()], axis=0)  # a row a task
        pairs = max(v[0], 1.0)
        return (v[1] / pairs + ridge * (w @ w) / 2, v[2:2 + d] / pairs + ridge * w,
                v[2 + d:].reshape(d, d) / pairs + ridge * np.eye(d))

    w = np.zeros(d)
    loss, grad, hess = at(w)
    for _ in range(50):
        step, t = np.linalg.solve(hess, grad), 1.0
        if np.abs(step).max() < 1e-8:
            break
        new = at(w - step)
        while t > 1e-6 and new[0] > loss + 1e-15:
            t /= 2
            new = at(w - t * step)
        w = w - t * step
        loss, grad, hess = new
    return w


def two_at(rows: DataFrame, rank: int) -> tuple[float, float]:
    """The values of column s with ``rank`` and ``rank`` + 1 others before them (the last one, where there is no next).

    A round counts the rows of SELECT_RANGES ranges and goes on in the one that holds the rank.
    """
    lo, hi = rows.agg(F.min("s"), F.max("s")).first()
    before = 0
    while lo < hi:
        at = F.when(F.col("s") >= hi, SELECT_RANGES).otherwise(
            F.least(F.floor((F.col("s") - lo) / F.lit(hi - lo) * SELECT_RANGES), F.lit(SELECT_RANGES - 1)))
        found = rows.where(F.col("s").between(lo, hi)).groupBy(at.alias("b")).agg(
            F.count("s").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).collect()
        for r in sorted(found, key=lambda r: r["b"]):
            if rank - before < r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            before += r["n"]
    upto, following = rows.agg(F.count_if(F.col("s") <= lo), F.min(F.when(F.col("s") > lo, F.col("s")))).first()
    return lo, lo if upto > rank + 1 or following is None else following


def _strengths(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.strength(_matrix(b.column("x"))))], ["s"])
    return run


def train(docs: DataFrame, labels: DataFrame, rows: DataFrame | None = None) -> Model:
    """Fit on all labelled documents, held-out ones left out; ``rows`` is ``feature_rows(docs)``."""
    known = labels.where("quality in (0, 1)").where(~held_out()).select(
        F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality"))
    share = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}  # two rows
    nothing = fit(np.zeros((0, len(FEATURES))), np.zeros(0), 0.0)
    if len(share) < 2:
        return nothing
    rows = feature_rows(docs) if rows is None else rows
    learnt = materialize(rows.join(known, F.col("doc_id") == F.col("_id")).select("doc_id", "quality", "x"), "quality-learnt")
    counts = {r["quality"]: r["count"] for r in learnt.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return nothing
    stats = learnt.agg(*[f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(len(FEATURES))]).first()
    mean, scale = np.array(stats[:len(FEATURES)]), np.array(stats[len(FEATURES):])
    scale[scale < 1e-9] = 1.0
    model = Model(mean, scale, fit_blocks(blocks(learnt, counts, mean, scale)), 0.0)
    s = materialize(learnt.select("x").mapInArrow(_strengths(model), "s double"), "quality-strengths")
    n = counts[0] + counts[1]
    rank = min(max(int(np.ceil(share[0] / (share[0] + share[1]) * n - 1e-9)) - 1, 0), n - 1)
    model.cut = sum(two_at(s, rank)) / 2
    return model


def _score(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(_matrix(b.column("x")))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= CUT_SCORE).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])
    return run


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = feature_rows(docs)
    return rows.mapInArrow(_score(train(docs, labels, rows)),
                           f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
