"""Toxicity by nearest labelled examples: exact TF-IDF cosine on block-max inverted indexes.

Terms are lower-cased words and, of words of more than STEM letters, their
first STEM letters. A term takes part if label 1 is at least LEAST_LIFT times as
frequent among its documents as among all, or at most that part as frequent, and
the likelihood-ratio statistic is at least LEAST_G2, counted over all labels learnt
from (each text once a label); of more than ``terms`` such terms those with the
highest statistic do. Its idf is counted over all documents.

Examples are the labelled documents that hold a term, at most about
``per_label`` of each label, chosen by hash of their ids. The index keeps for
every term the examples that hold it and their weights, in blocks of BLOCK
examples, and the greatest weight of each block. A text's nearest examples
are found without scoring all: block maxima give each block's upper bound,
blocks are scored in order of their bounds, and the search ends when no bound
left reaches the k-th best cosine. The result is the exact top k; ties go to
the example that comes first.

The neighbours vote with a weight that grows as their distance shrinks and
that restores the labels' shares; a prior of small weight stands for no vote.
A logistic curve, fitted to the votes that each example gets from the others,
turns votes into calibrated scores. Evidence: the nearest examples with their
cosines and labels (``evidence``).

Edge cases: a null or empty text, and any text without a term, has no
neighbours and gets the share of label 1 among the labelled texts without a term. Labels that are null or contradict each
other count as they stand; a null doc_id is never held out and matches no
label. Repeated rows are scored alike; of repeated labelled texts one is
counted a label, so that a large group of copies can't outvote the rest. With one
label or none to learn from there are no terms, and every score is that label's
share (0 without any). A very long text is counted once, in memory proportional to it; an empty table gives
no rows. Other columns aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_enough, text_key

# ASCII characters but letters and digits, and the marks and blanks of Latin-1, general and CJK punctuation.
MARKS_TO_BLANKS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
OTHER_MARKS = re.compile("[\u0080-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u00d7\u00f7\u2000-\u206f\u3000-\u303f]")
MANY = 5_000  # words from which on a text's words are counted all at once
STEM = 5
LEAST_G2, LEAST_LIFT, LEAST_DOCS = 24.0, 2.0, 3
TERMS, PER_LABEL = 20_000, 3_000
NEIGHBOURS, BLOCK = 20, 32
SHARPNESS, PRIOR_WEIGHT, LEAST_VOTE, RIDGE = 2.0, 0.1, 1e-6, 1e-3
CUT = 0.5
FLUSH = 1 << 16


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of ASCII letters and digits and of other characters but white space and punctuation."""
    plain = (text or "").lower()
    if not plain.isascii():
        plain = OTHER_MARKS.sub(" ", plain)
    return plain.encode().translate(MARKS_TO_BLANKS).decode().split()


def stems_of(words: list[str]) -> list[str]:
    return [w[:STEM] for w in words if len(w) > STEM]


def term_counts(text: str | None) -> Counter:
    """How often each term occurs in a text; stems carry a mark that no word holds."""
    words = words_of(text)
    return Counter(words) + Counter(x + "*" for x in stems_of(words))


class Terms:
    """Numbers of the terms that take part."""

    def __init__(self, names: list[str]):
        self.names = names
        self.words = {t: i for i, t in enumerate(names) if t[-1] != "*"}
        self.stems = {t[:-1]: i for i, t in enumerate(names) if t[-1] == "*"}

    def counts(self, text: str | None) -> dict[int, int]:
        """How often each term that takes part occurs in a text, by number."""
        words = words_of(text)
        stems = stems_of(words)
        out = {self.words[w]: words.count(w) for w in self.words.keys() & set(words)} if len(words) < MANY else \
            {self.words[w]: n for w, n in Counter(words).items() if w in self.words}
        return out | {self.stems[x]: n for x, n in Counter(x for x in stems if x in self.stems).items()}


# --- block-max index ---------------------------------------------------------

class Lists:
    """Rows of different length, one after the other."""

    def __init__(self, owner: np.ndarray, rows: int, *values: np.ndarray):
        """``owner`` ascends; each of ``values`` belongs to the owner at its place."""
        self.at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])
        self.values = values

    def places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all values of ``rows``, and which of ``rows`` each belongs to."""
        n = self.at[rows + 1] - self.at[rows]
        whose = np.repeat(np.arange(len(rows)), n)
        return self.at[rows][whose] + np.arange(len(whose)) - (np.cumsum(n) - n)[whose], whose


class BlockMaxIndex:
    """Inverted index over unit vectors with the greatest weight of every term in every block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        """``vectors``: (term numbers, weights) of each example, weights of unit length."""
        self.n = len(vectors)
        self.blocks = -(-self.n // BLOCK)
        term = np.concatenate([np.empty(0, np.int64), *(t for t, _ in vectors)]).astype(np.int64)
        weight = np.concatenate([np.empty(0), *(w for _, w in vectors)])
        example = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors])
        order = np.lexsort((example, term))
        term, weight, example = term[order], weight[order], example[order]
        cell = term * max(self.blocks, 1) + example // BLOCK  # (term, block), ascending
        cells, first = np.unique(cell, return_index=True)
        most = np.maximum.reduceat(weight, first) if len(cells) else np.empty(0)
        self._cells = Lists(cells // max(self.blocks, 1), terms, cells % max(self.blocks, 1), most)
        self._postings = Lists(np.repeat(np.arange(len(cells)), np.diff(np.append(first, len(cell)))), len(cells), example, weight)

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, leave_out: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k examples with the greatest positive cosine, best first."""
        none = np.empty(0, np.int64), np.empty(0)
        at, whose = self._cells.places(term)
        if not len(at):
            return none
        block, most = self._cells.values[0][at], self._cells.values[1][at]
        bound = np.bincount(block, most * weight[whose], self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        by_block = np.argsort(block, kind="stable")
        cells = Lists(block[by_block], self.blocks, by_block)
        found, cosines, done, step = *none, 0, 8
        while done < len(order):
            if len(found) >= k and bound[order[done]] < cosines[k - 1] - 1e-9:
                break
            mine = by_block[cells.places(order[done:done + step])[0]]
            place, of = self._postings.places(at[mine])
            example, w = self._postings.values[0][place], self._postings.values[1][place]
            own, inverse = np.unique(example, return_inverse=True)
            cosine = np.bincount(inverse, w * weight[whose[mine]][of], len(own))
            keep = own != leave_out
            found, cosines = np.concatenate([found, own[keep]]), np.concatenate([cosines, cosine[keep]])
            best = np.lexsort((found, -np.round(cosines, 12)))[:k]
            found, cosines = found[best], cosines[best]
            done, step = done + step, step * 4
        return found, np.minimum(cosines, 1.0)


# --- model -------------------------------------------------------------------

class Model:
    """Terms with their idf, the index over the examples, their labels, and the curve of the scores."""

    def __init__(self, terms: list[str], idf: np.ndarray, examples: list[tuple[object, int, dict[int, int]]],
                 all_labels: tuple[int, int], with_terms: tuple[int, int], k: int = NEIGHBOURS):
        """``examples``: (id, label, counts of terms by number); how many texts of label 0 and 1 there are, and how many hold a term."""
        self.terms, self.idf, self.k = Terms(terms), idf, k
        self.share = _share(with_terms)
        rest = (all_labels[0] - with_terms[0], all_labels[1] - with_terms[1])
        self.otherwise = _share(all_labels) if not sum(rest) else (rest[1] + _share(all_labels)) / (sum(rest) + 1)
        vectors = [self.vector(c) for _, _, c in examples]
        # examples of one block are alike: those with the same heaviest term stand together
        lead = [int(t[np.argmax(w)]) for t, w in vectors]
        order = sorted(range(len(examples)), key=lambda i: (lead[i], examples[i][1], str(examples[i][0])))
        self.ids, self.labels = [examples[i][0] for i in order], np.array([examples[i][1] for i in order], np.int64)
        vectors = [vectors[i] for i in order]
        self.index = BlockMaxIndex(vectors, len(terms))
        taken = np.maximum(np.bincount(self.labels, minlength=2), 1)
        self.weight = (np.array(with_terms) / taken)[self.labels]
        self.curve = (1.0, 0.0)
        if 0 < self.share < 1:
            x = np.array([self.vote(*self.index.nearest(t, w, self.k, i)) for i, (t, w) in enumerate(vectors)])
            self.curve = fitted(x, self.labels, self.weight)

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and TF-IDF weights, of unit length."""
        known = sorted(counts.items())
        term = np.array([t for t, _ in known], np.int64)
        w = (1 + np.log(np.array([n for _, n in known], np.float64))) * self.idf[term]
        size = np.sqrt(w @ w)
        return (term, w / size) if size > 0 else (term[:0], w[:0])

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        """Log odds of the neighbours' vote."""
        w = cosines ** SHARPNESS / (1.02 - cosines) * self.weight[found]
        p = (w @ self.labels[found] + PRIOR_WEIGHT * self.share) / (w.sum() + PRIOR_WEIGHT)
        p = min(max(p, LEAST_VOTE), 1 - LEAST_VOTE)
        return float(np.log(p / (1 - p)))

    def score(self, text: str | None) -> tuple[float, list[tuple[object, float, int]]]:
        """Calibrated score, and the neighbours (id, cosine, label)."""
        found, cosines = self.index.nearest(*self.vector(self.terms.counts(text)), self.k)
        if not len(found):
            return self.otherwise, []
        a, b = self.curve
        s = 1 / (1 + np.exp(-np.clip(a * self.vote(found, cosines) + b, -500, 500)))
        return float(s), [(self.ids[i], float(c), int(self.labels[i])) for i, c in zip(found.tolist(), cosines)]


def _share(counts: tuple[int, int]) -> float:
    """Of label 1; 0 where there is none of either."""
    return counts[1] / sum(counts) if sum(counts) else 0.0


def fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from votes to labels (Newton with halving)."""
    a = np.stack([x, np.ones(len(x))], axis=1)

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(weight @ (np.logaddexp(0, z) - y * z) + RIDGE * (w @ w) / 2)

    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        grad = a.T @ (weight * (p - y)) + RIDGE * w
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + RIDGE * np.eye(2), grad)
        t = 1.0
        while t > 1e-6 and loss(w - t * step) > loss(w):
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


# --- training ----------------------------------------------------------------

def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _term_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = []
        for t in b.column("text"):
            words = words_of(t.as_py())
            lists.append([*set(words), *{x + "*" for x in stems_of(words)}])
        yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(lists, pa.list_(pa.string()))], ["toxic", "terms"])


def _by_label(rows: DataFrame) -> tuple[int, int]:
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}  # two rows
    return n.get(0, 0), n.get(1, 0)


def label_terms(known: DataFrame, terms: int = TERMS) -> list[str]:
    """The terms that tell the labels apart, at most ``terms``, in order."""
    size = _by_label(known)
    if not all(size):
        return []
    each = known.select("toxic", "text").mapInArrow(_term_lists, "toxic int, terms array<string>")
    counts = each.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("n1")).where(F.col("n") >= LEAST_DOCS)
    n, n1, all_1, total = F.col("n"), F.col("n1"), float(size[1]), float(size[0] + size[1])

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)

    g2 = (part(n1, n * all_1 / total) + part(n - n1, n * (total - all_1) / total)
          + part(all_1 - n1, (total - n) * all_1 / total) + part(total - all_1 - n + n1, (total - n) * (total - all_1) / total))
    share = n1 / n * (total / all_1)  # of label 1, against that of all texts
    telling = (share >= LEAST_LIFT) | (share <= 1 / LEAST_LIFT)
    picked = counts.withColumn("g2", F.round(g2, 6)).where((F.col("g2") >= LEAST_G2) & telling).orderBy(F.desc("g2"), "term").limit(terms)
    return sorted(r["term"] for r in picked.select("term").collect())


def _frequencies(terms: Terms) -> Callable:
    """Partial document counts of the terms: one list a task and FLUSH documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = np.zeros(len(terms.names), np.int64), 0

        def row() -> pa.RecordBatch:
            some = np.flatnonzero(count)
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some], pa.int64())], ["term", "n"])

        for b in batches:
            for t in b.column("text"):
                count[list(terms.counts(t.as_py()))] += 1
            seen += b.num_rows
            if seen >= FLUSH:
                yield row()
                count[:], seen = 0, 0
        yield row()
    return run


def document_frequencies(docs: DataFrame, terms: list[str]) -> np.ndarray:
    """How many of all documents hold each term."""
    parts = docs.select("text").mapInArrow(_frequencies(Terms(terms)), "term int, n long")
    out = np.zeros(len(terms))
    for r in parts.groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most a row a term
        out[r["term"]] = r["n"]
    return out


def _examples(terms: Terms) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [terms.counts(x.as_py()) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("toxic"), pa.array([list(c) for c in counts], pa.list_(pa.int32())),
                 pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))], ["id", "toxic", "term", "times"])
    return run


def _labelled(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(id, toxic, text), written once: one document for each labelled text and label.

    Labels and copies are settled on ids and digests alone; texts are then
    fetched by a broadcast of the chosen ids where their number allows it.
    """
    texts = docs.select("doc_id", "text", text_key().alias("key"))
    known = texts.select("doc_id", "key").join(marks, F.col("doc_id") == F.col("_id"))
    rows = known.groupBy("key", "toxic", F.col("doc_id").cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("key", "toxic").agg(F.min(F.struct("id", "n")).alias("f"))
    chosen = materialize(first.select(F.col("key").alias("_key"), "toxic", "f.id", "f.n"), "toxic-labels")
    side = F.broadcast(chosen) if small_enough(chosen.count(), 96) else chosen
    found = texts.join(side, (F.col("key") == F.col("_key")) & (F.col("doc_id").cast("string") == F.col("id")))
    found = materialize(found.select("key", "id", "toxic", "n", "text"), "toxic-texts")
    once = found.where("n = 1")
    if not chosen.where("n > 1").isEmpty():  # a repeated row: one of them
        once = once.unionByName(found.where("n > 1").dropDuplicates(["key", "toxic"]))
    return once.select("id", "toxic", "text")


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, terms: int = TERMS) -> Model:
    """Terms from all labels that aren't held out, idf from all documents, about ``per_label`` examples of each label."""
    marks = labels.where("toxic in (0, 1)").where(~held_out()).select(
        F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    labelled = _labelled(docs, marks)
    size = _by_label(labelled)
    names = label_terms(labelled, terms)
    if not names:
        return Model([], np.empty(0), [], size, (0, 0))
    rows = labelled.mapInArrow(_examples(Terms(names)), "id string, toxic int, term array<int>, times array<int>").where(F.size("term") > 0)
    rows = materialize(rows, "toxic-examples")
    have = _by_label(rows)
    quota = F.when(F.col("toxic") == 1, per_label / max(have[1], 1)).otherwise(per_label / max(have[0], 1))
    picked = rows.where(F.xxhash64("id", "toxic") / 2.0 ** 64 + 0.5 < quota).collect()  # about 2 * per_label rows
    df = document_frequencies(docs, names)
    idf = np.log(1 + docs.count() / np.maximum(df, 1))
    picked.sort(key=lambda r: (r["id"], r["toxic"]))
    return Model(names, idf, [(r["id"], r["toxic"], dict(zip(r["term"], r["times"]))) for r in picked],
                 size, have)


def _scored(model: Model, proof: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.score(t.as_py()) for t in b.column("text")]
            s = np.array([x for x, _ in found], np.float64)
            cols = [b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= CUT).astype(np.int32))]
            if proof:
                cols.append(pa.array([[{"id": str(i), "cosine": c, "toxic": y} for i, c, y in e[:proof]] for _, e in found],
                                     pa.list_(pa.struct([("id", pa.string()), ("cosine", pa.float64()), ("toxic", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted"] + ["evidence"] * bool(proof))
    return run


def score_documents(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, evidence: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every document and, if asked for, its nearest examples."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    schema = f"doc_id {kind}, held_out boolean, score double, predicted int"
    if evidence:
        schema += ", evidence array<struct<id: string, cosine: double, toxic: int>>"
    return rows.mapInArrow(_scored(train(docs, labels, per_label), evidence), schema)
