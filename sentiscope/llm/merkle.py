"""Merkle manifest of a dataset, with octopus multiproofs.

Every document is a leaf. Per source the leaves, in ascending doc_id, are
leaves of a tree of arity 3 whose top node is the source's subroot; the
subroots, ordered by source, are the leaves of the tree whose top is the root.
A node is the SHA-256 of its children's digests in hex.

The leaves are dealt out by range over (source, doc_id), so that a partition
holds a run of neighbouring leaves of every source it touches, and a hot
source is spread over as many partitions as its rows need. Interior nodes are
made in tasks of at most 3**DEPTH nodes, DEPTH levels a round, and written.

For the proofs, each leaf partition works out the coordinates (tree, level,
index) of the nodes that all of its proofs together need and that don't follow
from its own leaves: the siblings beside the two ends of each run, level by
level, and beside its run of subroots. This union is minimal, has at most four
nodes a level, and is fetched by one join. The partition then derives the
interior nodes that its proofs share once, and expands every single proof from
them (``proofs``).

Edge cases: a null value enters a leaf as ``-``. A null source is a tree of its
own, the first one; leaves without doc_id come first in their tree. Equal
doc_ids follow in order of their leaf digests, and equal rows have equal leaves,
so that their order can't change a digest; one repeated row may fill any number
of partitions. An empty table has no root and no rows. A very long text costs
its digest only. Other columns aren't read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

ARITY = 3
DEPTH = 6  # levels of a round; a task's group is at most ARITY ** DEPTH nodes
PART_ROWS = 20_000  # leaves of a partition, about
POSITION_BITS = 33  # of monotonically_increasing_id: partition above, row below
LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


# --- plain trees -------------------------------------------------------------

def parent(digests: list[str]) -> str:
    """H of up to ARITY children, as hex."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def missing(first: int, last: int, n: int) -> list[tuple[int, int]]:
    """The octopus: coordinates (level, index) that the proofs of leaves first .. last need together.

    Level by level, the children of the nodes derived so far that aren't
    derived themselves; all of them lie beside the two ends of the run.
    """
    out, level = [], 0
    while n > 1:
        low, high = first // ARITY * ARITY, min(last // ARITY * ARITY + ARITY, n)
        out += [(level, i) for i in itertools.chain(range(low, first), range(last + 1, high))]
        first, last, n, level = first // ARITY, last // ARITY, -(-n // ARITY), level + 1
    return out


class Trunk:
    """All nodes that a run of leaves and the fetched nodes give, up to the top."""

    def __init__(self, first: int, leaves: list[str], n: int, fetched: dict[tuple[int, int], str]):
        self.levels: list[tuple[int, list[str]]] = []
        level, nodes = 0, leaves
        while n > 1:
            end = first + len(nodes)
            low, high = first // ARITY * ARITY, min((end - 1) // ARITY * ARITY + ARITY, n)
            nodes = [fetched[level, i] for i in range(low, first)] + nodes + [fetched[level, i] for i in range(end, high)]
            self.levels.append((low, nodes))
            nodes = [parent(nodes[k:k + ARITY]) for k in range(0, len(nodes), ARITY)]
            first, n, level = low // ARITY, -(-n // ARITY), level + 1
        self.top = nodes[0]
        self._above: list[dict[int, list[tuple[int, list[str]]]]] = [{} for _ in self.levels]

    def path(self, leaf: int, level: int = 0) -> list[tuple[int, list[str]]]:
        """(place among its siblings, siblings) at each level from ``level`` up; shared parts are made once."""
        if level == len(self.levels):
            return []
        known = self._above[level]
        if leaf not in known:
            low, nodes = self.levels[level]
            at = (leaf - low) // ARITY * ARITY
            run, place = nodes[at:at + ARITY], (leaf - low) - at
            step = [(place, run[:place] + run[place + 1:])] + self.path(leaf // ARITY, level + 1)
            if level == 0:
                return step
            known[leaf] = step
        return known[leaf]


def fold(leaf: str, path: list[tuple[int, list[str]]]) -> str:
    """The top that a leaf and its siblings give."""
    for place, siblings in path:
        leaf = parent(siblings[:place] + [leaf] + siblings[place:])
    return leaf


# --- leaves ------------------------------------------------------------------

def leaf_hash(text: Column) -> Column:
    """Hex digest of a row's columns, ``text`` in place of its text."""
    def field(c: Column) -> Column:
        s = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))
    return F.sha2(F.concat(*[field(text if c == "text" else F.col(c)) for c in LEAF_COLUMNS]), 256)


def tampered() -> Column:
    """Whether a row is one of those whose text loses its line ends: 2 divides its doc_id's crc32."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))


def leaves(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """(doc_id, tree, leaf, other): each row's leaf, and the leaf of its altered text or null; 32 bytes each."""
    other = F.lit(None).cast("binary")
    if altered is not None:
        other = F.when(altered.isNotNull(), F.unhex(leaf_hash(altered)))
    return docs.select("doc_id", F.col("source").cast("string").alias("tree"), F.unhex(leaf_hash(F.col("text"))).alias("leaf"),
                       other.alias("other"))


# --- numbering and nodes -----------------------------------------------------

def _part() -> Column:
    return F.shiftright("pos", POSITION_BITS).cast("int")


def _placed(rows: DataFrame, n: int, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Rows in order with their partition and place, and the run of each tree in each partition.

    Runs are (part, tree, first, n, start, total): first place, rows, index of
    the first row in its tree, rows of the tree. Equal rows are told apart by
    their place in the input, so that they spread as well.
    """
    parts = max(1, -(-n // PART_ROWS))
    dealt = rows.withColumn("_salt", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(parts, *order, "_salt").sortWithinPartitions(*order, "_salt").drop("_salt")
    placed = materialize(dealt.withColumn("pos", F.monotonically_increasing_id()), f"{name}-placed")
    runs = placed.groupBy(_part().alias("part"), "tree").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")  # a row for each partition that the tree reaches
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(tree))
    return placed, materialize(runs, f"{name}-runs")


def _indexed(placed: DataFrame, runs: DataFrame, digest: str) -> DataFrame:
    """(tree, level, idx, total, digest): the leaves of all trees as nodes."""
    r = runs.select("part", F.col("tree").alias("_tree"), "first", "start", "total")
    same = (_part() == F.col("part")) & F.col("tree").eqNullSafe(F.col("_tree"))
    return placed.join(r, same).select(
        "tree", F.lit(0).alias("level"), (F.col("start") + F.col("pos") - F.col("first")).alias("idx"), "total",
        F.col(digest).alias("digest"))


NODE = "level int, idx long, total long, digest binary"


def _built(depth: int) -> Callable:
    """The nodes up to ``depth`` levels above each group of nodes; rows come sorted by tree and idx."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("tree", "level", "idx", "total", "digest")))

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (tree, _), group in itertools.groupby(rows(batches), key=lambda r: (r[0], r[2] // ARITY ** depth)):
            group = list(group)
            level, at, n = group[0][1], group[0][2], group[0][3]
            nodes = [r[4].hex() for r in group]
            for _ in range(depth):
                if n == 1:
                    break
                nodes = [parent(nodes[k:k + ARITY]) for k in range(0, len(nodes), ARITY)]
                level, at, n = level + 1, at // ARITY, -(-n // ARITY)
                yield from ((tree, level, at + i, n, bytes.fromhex(x)) for i, x in enumerate(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = grown(batches)
        while chunk := list(itertools.islice(made, 10_000)):
            tree, level, idx, total, digest = zip(*chunk)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tree, pa.string()), pa.array(level, pa.int32()), pa.array(idx, pa.int64()),
                 pa.array(total, pa.int64()), pa.array(digest, pa.binary())], ["tree", "level", "idx", "total", "digest"])
    return run


def _interior(nodes: DataFrame, most: int, name: str) -> DataFrame | None:
    """All nodes above the leaves ``nodes`` of trees of at most ``most`` leaves, or None if there are none."""
    out, current, level = None, nodes, 0
    while most > 1:
        group = F.floor(F.col("idx") / ARITY ** DEPTH)
        dealt = current.where("total > 1").repartition("tree", group).sortWithinPartitions("tree", "idx")
        made = materialize(dealt.mapInArrow(_built(DEPTH), "tree string, " + NODE), f"{name}-{level}")
        out = made if out is None else out.unionByName(made)
        level, most = level + DEPTH, -(-most // ARITY ** DEPTH)
        current = made.where(F.col("level") == level)
    return out


@dataclass
class Manifest:
    """``leaves`` (placed), ``nodes`` (top, tree, level, idx, digest) of every level, and the runs of both kinds."""

    leaves: DataFrame
    runs: DataFrame
    nodes: DataFrame
    ranks: DataFrame

    def subroots(self) -> DataFrame:
        """(source, n, subroot), hex."""
        return self.ranks.select(F.col("tree").alias("source"), "n_leaves", F.lower(F.hex("leaf")).alias("subroot"))

    def root(self) -> str | None:
        """The root, or None for an empty table."""
        r = self.nodes.where("top and total = 1").select(F.lower(F.hex("digest")).alias("root")).first()
        return r["root"] if r else None


def _trees(rows: DataFrame, n: int, order: list[str], name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Placed rows, runs and all nodes of the trees of ``rows``."""
    placed, runs = _placed(rows, n, order, name)
    base = materialize(_indexed(placed, runs, "leaf"), f"{name}-leaves")
    most = runs.agg(F.max("total").alias("m")).first()["m"] or 0
    above = _interior(base, most, name)
    return placed, runs, base if above is None else base.unionByName(above)


def manifest(docs: DataFrame, altered: Column | None = None) -> Manifest:
    """The trees of ``docs``; ``altered`` is a text to keep a second leaf of, null where there is none."""
    rows = materialize(leaves(docs, altered), "merkle-leaves")
    placed, runs, nodes = _trees(rows, rows.count(), ["tree", "doc_id", "leaf"], "merkle")
    subroots = materialize(nodes.where("total = 1").select("tree", F.col("digest").alias("leaf")).join(
        runs.where("start = 0").select(F.col("tree").alias("_t"), F.col("total").alias("n_leaves")),
        F.col("tree").eqNullSafe(F.col("_t"))).drop("_t"), "merkle-subroots")
    one = subroots.select("tree", F.lit(None).cast("string").alias("all"), "leaf", "n_leaves")
    one = one.withColumnRenamed("tree", "source").withColumnRenamed("all", "tree")
    top_placed, top_runs, top_nodes = _trees(one, one.count(), ["source"], "merkle-top")
    r = top_runs.select("part", "first", "start", "total")  # one tree: one run a partition
    ranks = materialize(top_placed.join(r, _part() == F.col("part")).select(
        F.col("source").alias("tree"), (F.col("start") + F.col("pos") - F.col("first")).alias("rank"),
        F.col("total").alias("sources"), "leaf", "n_leaves"), "merkle-ranks")
    every = nodes.withColumn("top", F.lit(False)).unionByName(top_nodes.withColumn("top", F.lit(True)))
    return Manifest(placed, runs, every, ranks)


# --- proofs ------------------------------------------------------------------

def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Coordinates that each run of leaves lacks."""
    for b in batches:
        out = [(part, top, tree, level, idx)
               for part, top, tree, start, n, total in zip(*(b.column(c).to_pylist() for c in (
                   "part", "top", "tree", "start", "n", "total")))
               for level, idx in missing(start, start + n - 1, total)]
        cols = list(zip(*out)) if out else [[]] * 5
        kinds = (pa.int32(), pa.bool_(), pa.string(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                         ["part", "top", "tree", "level", "idx"])


def _facts(m: Manifest) -> DataFrame:
    """What each leaf partition needs besides its leaves: its runs (level null) and the nodes fetched for it."""
    runs = m.runs.join(m.ranks.select(F.col("tree").alias("_t"), "rank", "sources"),
                       F.col("tree").eqNullSafe(F.col("_t"))).select("part", "tree", "start", "n", "total", "rank", "sources")
    runs = materialize(runs, "merkle-spans")
    across = runs.groupBy("part").agg(F.min("rank").alias("start"), F.count(F.lit(1)).alias("n"), F.first("sources").alias("total"))
    spans = runs.select("part", F.lit(False).alias("top"), "tree", "start", "n", "total").unionByName(
        across.select("part", F.lit(True).alias("top"), F.lit(None).cast("string").alias("tree"), "start", "n", "total"))
    wanted = spans.mapInArrow(_wanted, "part int, top boolean, tree string, level int, idx long")
    nodes = m.nodes.select(*[F.col(c).alias(f"_{c}") for c in ("top", "tree", "level", "idx")], "digest")
    same = [F.col(c) == F.col(f"_{c}") for c in ("top", "level", "idx")] + [F.col("tree").eqNullSafe(F.col("_tree"))]
    fetched = wanted.join(nodes, same).select("part", "top", "tree", "level", "idx", "digest")
    none = [F.lit(None).cast("long").alias(c) for c in ("start", "total", "rank", "sources")]
    return fetched.select("*", *none).unionByName(runs.select(
        "part", F.lit(False).alias("top"), "tree", F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("idx"),
        F.lit(None).cast("binary").alias("digest"), "start", "total", "rank", "sources"))


def _expand(paths: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, facts: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows.column("pos").to_numpy())))
        fetched: dict[tuple, dict[tuple[int, int], str]] = {}
        runs = {}
        for f in facts.to_pylist():
            if f["level"] is None:
                runs[f["tree"]] = f
            else:
                fetched.setdefault((f["top"], f["tree"]), {})[f["level"], f["idx"]] = f["digest"].hex()
        own = [x.hex() for x in rows.column("leaf").to_pylist()]
        groups = [(t, len(list(g))) for t, g in itertools.groupby(rows.column("tree").to_pylist())]
        trunks, at = [], 0
        for tree, n in groups:
            trunks.append(Trunk(runs[tree]["start"], own[at:at + n], runs[tree]["total"], fetched.get((False, tree), {})))
            at += n
        first = runs[groups[0][0]]
        top = Trunk(first["rank"], [t.top for t in trunks], first["sources"], fetched.get((True, None), {}))
        out: dict[str, list] = {k: [] for k in ("subroot", "proof_sha256", "folded_root", *["proof"] * paths)}
        other = rows.column("other").to_pylist()
        at = 0
        for (tree, n), trunk in zip(groups, trunks):
            above = top.path(runs[tree]["rank"])
            for i in range(n):
                path = trunk.path(runs[tree]["start"] + i) + above
                siblings = [x for _, s in path for x in s]
                leaf = own[at] if other[at] is None else other[at].hex()
                out["subroot"].append(trunk.top)
                out["proof_sha256"].append(parent(siblings))
                out["folded_root"].append(fold(leaf, path))
                if paths:
                    out["proof"].append(siblings)
                at += 1
        cols = {"doc_id": rows.column("doc_id"), "leaf": pa.array(own, pa.string()),
                "subroot": pa.array(out["subroot"], pa.string()), "root": pa.array([top.top] * len(own), pa.string())}
        cols |= {k: pa.array(out[k], pa.string()) for k in ("proof_sha256", "folded_root")}
        cols["verified"] = pa.array([x == top.top for x in out["folded_root"]], pa.bool_())
        if paths:
            cols["proof"] = pa.array(out["proof"], pa.list_(pa.string()))
        return pa.table(cols)
    return run


def proofs(m: Manifest, paths: bool = False) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and, if asked for, its proof.

    A proof lists the siblings from the leaf's level to the root's. It is
    folded with the altered leaf where there is one.
    """
    kind = dict(m.leaves.dtypes)["doc_id"]
    schema = (f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
              "verified boolean" + ", proof array<string>" * paths)
    rows = m.leaves.select(_part().alias("part"), "doc_id", "tree", "pos", "leaf", "other")
    return rows.groupBy("part").cogroup(_facts(m).groupBy("part")).applyInArrow(_expand(paths), schema)


def verify_documents(docs: DataFrame) -> DataFrame:
    """``proofs`` of ``docs``; rows chosen by ``tampered`` are folded with a text that lost its line ends."""
    return proofs(manifest(docs, F.when(tampered(), F.translate("text", "\n", ""))))
