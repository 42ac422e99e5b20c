"""Near-duplicate detection: circulant MinHash, banding, exact Jaccard verification.

Signatures come from two permutations of a 32-bit universe: sigma spreads the
shingle ids, and coordinate k is the least pi(sigma(x) + k) over the shingles,
that is pi shifted circularly by k. A hundred and twenty coordinates of 16
bits are cut into 30 bands of 4.

Copies (equal shingle sets, by a 128-bit digest) form one class; all further
work is on classes. Classes that share a band meet in a bucket:

* a bucket of at most SMALL classes gives all its pairs;
* a larger bucket first gives a maximum spanning forest of its classes by
  signature agreement, at most one pair per class, in blocks of BLOCK classes;
* once the components of the verified pairs are known, larger buckets that share
  classes form a group, in which a pair of classes meets once however many
  buckets it shares (or stay apart, where that makes fewer pairs). The
  classes of a group that lie outside its main component are compared with all
  of the group's classes of other components, block by block: the sizes of
  all intersections of two blocks are one product of their 0/1 shingle
  matrices, so that these comparisons are exact.

So a link between two texts that share a bucket is lost only where it joins
nothing new. Every link is confirmed on the full shingle sets. With a
similarity at the threshold of 0.85 a pair misses all 30 bands with
probability 6e-10 (at 0.8: 1.4e-7), and signature agreement rules a pair of the
forest out wrongly with about 1e-7.

Edge cases: null, empty and word-less texts have no shingles and link with
nothing; a text of one to four words is one shingle. Repeated doc_ids are
separate rows with the same id. A null doc_id takes part; the component's id
is the smallest non-null one, and null where there is none. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, materialize, small_enough, text_key
from .components import connected_components

SHINGLE = 5
BANDS, ROWS = 30, 4
COORDS = BANDS * ROWS
CACHE = 1 << 16
SMALL = 8
BLOCK = 2048
SHINGLES = 1 << 20  # of a block of classes that are compared exactly
COLUMNS, SPARSE, PAIRS = 2048, 64, 1 << 20  # of its matrix products, and when and how columns are counted by pairs

_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                  0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes | None, hashes: Cache) -> np.ndarray:
    """Sorted distinct 64-bit ids of a text's shingles (ASCII-lower-cased words)."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(SHINGLE, n)
    m = n - width + 1
    ids = np.full(m, width, np.uint64)
    for k in range(width):
        ids += w[k:k + m] * _STEP[k]
    return np.unique(_mix64(ids))


def coordinates(ids: np.ndarray, first: int, count: int) -> np.ndarray:
    """Circulant MinHash coordinates first .. first + count - 1 of a non-empty set."""
    sigma = (_mix64(ids ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)).astype(np.uint32)
    least = np.full(count, 0xFFFFFFFF, np.uint32)
    shift = np.arange(first, first + count, dtype=np.uint32)[:, None]
    for at in range(0, len(sigma), 512):  # blocks that stay in cache
        x = sigma[None, at:at + 512] + shift
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        np.minimum(least, x.min(axis=1), out=least)
    return least


def signature(ids: np.ndarray) -> bytes:
    """COORDS coordinates, the low 16 bits of each, little-endian."""
    return (coordinates(ids, 0, COORDS) & np.uint32(0xFFFF)).astype("<u2").tobytes()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Cache(xxhash.xxh3_64_intdigest, CACHE)
    for b in batches:
        digests, counts, sigs = [], [], []
        for text in b.column("text"):
            ids = shingle_set(text.as_py(), hashes)
            counts.append(len(ids))
            digests.append(hashlib.blake2b(ids.tobytes(), digest_size=16).digest() if len(ids) else None)
            sigs.append(signature(ids) if len(ids) else None)
        own = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*map(b.column, own), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
             pa.array(sigs, pa.binary())], [*own, "n_shingles", "digest", "sig"])


def _shingle_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Cache(xxhash.xxh3_64_intdigest, CACHE)
    for b in batches:
        digests, sets = [], []
        for text in b.column("text"):
            ids = shingle_set(text.as_py(), hashes)
            digests.append(hashlib.blake2b(ids.tobytes(), digest_size=16).digest() if len(ids) else None)
            sets.append(ids.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(digests, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["digest", "ids"])


def signatures(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """(doc_id, n_shingles, digest, sig) of every document; ``keyed``: its text's _key after doc_id."""
    kind = dict(docs.dtypes)["doc_id"]
    key = [text_key().alias("_key")] if keyed else []
    return docs.select("doc_id", *key, F.col("text").cast("binary").alias("text")).mapInArrow(
        _sign, f"doc_id {kind}, {'_key binary, ' if keyed else ''}n_shingles long, digest binary, sig binary")


def least_agreement(num: int, den: int) -> int:
    """Coordinates that a pair at the threshold shares but for a chance of about 1e-7."""
    t = num / den
    return int(COORDS * max(0.0, t - 5.2 * (t * (1 - t) / COORDS) ** 0.5))


def _matrix(p: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(p["sig"]), "<u2").reshape(-1, COORDS)


def _forest(least: int, num: int, den: int):
    """Prim's algorithm on signature agreement within one block of a bucket."""
    def pairs(p: pd.DataFrame) -> pd.DataFrame:
        sig, size, ids = _matrix(p), p["n_shingles"].to_numpy(), p["digest"].to_list()
        n = len(p)
        best, near = np.full(n, -1), np.zeros(n, np.int64)
        todo = np.ones(n, bool)
        at, out = 0, []
        for _ in range(n - 1):
            todo[at] = False
            agree = (sig == sig[at]).sum(axis=1)
            agree[den * np.minimum(size, size[at]) < num * np.maximum(size, size[at])] = -1
            better = todo & (agree > best)
            best[better], near[better] = agree[better], at
            at = int(np.argmax(np.where(todo, best, -2)))
            if best[at] >= least:
                out.append((ids[at], ids[near[at]]))
        return pd.DataFrame(out, columns=["x", "y"])
    return pairs


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of ``b`` (sorted distinct ids).

    Ids that both sides hold are columns of two 0/1 matrices. Columns that few
    pairs share are counted pair by pair, the others by matrix products of COLUMNS
    columns at a time.
    """
    out = np.zeros((len(a), len(b)), np.float32)
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(flat_a, flat_b)
    if not len(shared):
        return out

    def cells(flat: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows by column: the row of each id that is shared, sorted by column, and where each column starts."""
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        held = shared[at] == flat
        order = np.argsort(at[held], kind="stable")
        column = at[held][order]
        return row[held][order], column, np.searchsorted(column, np.arange(len(shared) + 1))

    row_a, col_a, start_a = cells(flat_a, a)
    row_b, col_b, start_b = cells(flat_b, b)
    n_a, n_b = np.diff(start_a), np.diff(start_b)
    few = n_a * n_b * SPARSE < len(a) * len(b)
    some = np.flatnonzero(few)
    while len(some):  # about PAIRS pairs at a time
        upto = max(1, int(np.searchsorted(np.cumsum((n_a * n_b)[some]), PAIRS)))
        c, some = some[:upto], some[upto:]
        n = n_a[c] * n_b[c]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat(n_b[c], n)
        i = row_a[np.repeat(start_a[c], n) + k // width]
        j = row_b[np.repeat(start_b[c], n) + k % width]
        np.add.at(out, (i, j), 1)
    many = np.flatnonzero(~few)
    for at in range(0, len(many), COLUMNS):
        c = many[at:at + COLUMNS]
        place = np.full(len(shared), -1)
        place[c] = np.arange(len(c))
        x, y = np.zeros((len(a), len(c)), np.float32), np.zeros((len(b), len(c)), np.float32)
        for m, row, column in ((x, row_a, col_a), (y, row_b, col_b)):
            inside = place[column] >= 0
            m[row[inside], place[column[inside]]] = 1
        out += x @ y.T
    return out


def _crossing(num: int, den: int):
    """Links between components, one for each two, among the classes of one block of outside classes and one of all."""
    def links(p: pd.DataFrame) -> pd.DataFrame:
        outside, comp = p["outside"].to_numpy(), p["comp"].to_numpy()
        a, b = np.flatnonzero(outside), np.flatnonzero(~outside)
        sets = [np.asarray(x) for x in p["ids"]]
        found: set[tuple[bytes, bytes]] = set()
        if len(a) and len(b):
            size = np.array([len(x) for x in sets], np.float32)
            both = intersections([sets[i] for i in a], [sets[j] for j in b])
            linked = den * both >= num * (size[a][:, None] + size[b][None, :] - both)
            found = {(min(x, y), max(x, y)) for x, y in zip(comp[a[np.nonzero(linked)[0]]], comp[b[np.nonzero(linked)[1]]]) if x != y}
        return pd.DataFrame(sorted(found), columns=["u", "v"])
    return links


PAIR = "x binary, y binary"


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x <> y").distinct()


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): the pairs whose full shingle sets reach the similarity num / den."""
    a = sets.select(F.col("digest").alias("x"), F.col("ids").alias("a"))
    b = sets.select(F.col("digest").alias("y"), F.col("ids").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return (pairs.join(a, "x").join(b, "y")
            .select("x", "y", both.alias("both"), (F.size("a") + F.size("b")).alias("total"))
            .where(F.lit(den) * F.col("both") >= F.lit(num) * (F.col("total") - F.col("both")))
            .select(F.col("x").alias("u"), F.col("y").alias("v")))


def _buckets(classes: DataFrame) -> DataFrame:
    """(bucket, band, digest, n): the classes of every bucket that holds two or more."""
    rows = classes.select("digest", "sig", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    rows = rows.select("digest", "band", F.xxhash64(
        "band", F.substring("sig", F.col("band") * (2 * ROWS) + 1, F.lit(2 * ROWS))).alias("bucket"))
    shared = materialize(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "dedup-shared")
    side = F.broadcast(shared) if small_enough(shared.count(), 32) else shared
    return materialize(rows.join(side, "bucket"), "dedup-buckets")


def _sets(docs: DataFrame, classes: DataFrame, buckets: DataFrame) -> DataFrame:
    """(digest, ids): the shingle sets of the classes that share a bucket, from one text each."""
    active = buckets.select("digest").distinct()
    reps = materialize(classes.join(active, "digest").select(F.col("rep").alias("_rep"), "digest"), "dedup-reps")
    wanted = reps.select("_rep").distinct()
    side = F.broadcast(wanted) if small_enough(reps.count(), 24) else wanted
    texts = docs.select("doc_id", "text").join(side, F.col("doc_id").eqNullSafe(F.col("_rep"))).select(
        F.col("text").cast("binary").alias("text"))
    lists = texts.mapInArrow(_shingle_lists, "digest binary, ids array<long>")
    # a repeated doc_id gives its text, and so its set, more than once
    return materialize(lists.join(reps.select("digest"), "digest", "left_semi").dropDuplicates(["digest"]),
                       "dedup-sets")


def _spanning_pairs(buckets: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    small = (buckets.where(F.col("n") <= SMALL).groupBy("bucket")
             .agg(F.sort_array(F.collect_list("digest")).alias("d"))
             .select(F.explode(F.flatten(F.transform("d", lambda x, i: F.transform(
                 F.slice("d", i + 2, F.size("d")), lambda y: F.struct(x.alias("x"), y.alias("y")))))).alias("p"))
             .select("p.x", "p.y"))
    blocks = (buckets.where(F.col("n") > SMALL).join(classes.select("digest", "n_shingles", "sig"), "digest")
              .withColumn("block", F.pmod(F.xxhash64("digest"), F.ceil(F.col("n") / BLOCK))))
    large = blocks.select("bucket", "block", "digest", "n_shingles", "sig").groupBy("bucket", "block").applyInPandas(
        _forest(least_agreement(num, den), num, den), PAIR)
    return _ordered(small.union(large))


def _blocks(rows: DataFrame) -> DataFrame:
    """(unit, digest, comp, outside, i, j): the classes of each unit in blocks, each pair of blocks once.

    Rows are (unit, digest, comp, size). A block has at most about BLOCK classes and
    SHINGLES shingles; units without classes outside their main component are left out.
    """
    count = rows.groupBy("unit", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("s"))
    main = count.groupBy("unit").agg(F.max(F.struct("k", "comp", "s")).alias("m"), F.sum("k").alias("n"), F.sum("s").alias("t"))

    def blocks(n, t):
        return F.greatest(F.ceil(n / BLOCK), F.ceil(t / SHINGLES), F.lit(1)).cast("int")

    main = main.select("unit", F.col("m.comp").alias("main"), blocks(F.col("n"), F.col("t")).alias("all_blocks"),
                       (F.col("n") - F.col("m.k")).alias("n_out"),
                       blocks(F.col("n") - F.col("m.k"), F.col("t") - F.col("m.s")).alias("out_blocks")).where("n_out > 0")
    d = rows.join(main, "unit").withColumn("h", F.xxhash64("digest"))

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    whole = d.select("unit", "digest", "comp", F.lit(False).alias("outside"),
                     F.pmod("h", F.col("all_blocks")).cast("int").alias("i"), every("out_blocks").alias("j"))
    return whole.unionByName(d.where("comp <> main").select(
        "unit", "digest", "comp", F.lit(True).alias("outside"), every("all_blocks").alias("i"),
        F.pmod("h", F.col("out_blocks")).cast("int").alias("j")))


def _crossing_links(buckets: DataFrame, classes: DataFrame, sets: DataFrame, comps: DataFrame,
                    num: int, den: int) -> DataFrame | None:
    """(u, v): components that a verified link within the larger buckets joins, or None where no such bucket is open."""
    rows = (buckets.where(F.col("n") > SMALL).join(classes.select("digest", F.col("n_shingles").alias("size")), "digest")
            .join(comps, F.col("digest") == F.col("node"), "left")
            .select("bucket", "digest", "size", F.coalesce("root", "digest").alias("comp")))
    spread = rows.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.min("digest").alias("first")).where("a <> b")
    d = materialize(rows.join(spread.select("bucket", "first"), "bucket"), "dedup-open")
    if d.isEmpty():
        return None
    groups = connected_components(d.select(F.col("digest").alias("u"), F.col("first").alias("v")))
    d = materialize(d.join(groups.select("node", F.col("root").alias("group")), F.col("digest") == F.col("node")).drop("node"), "dedup-grouped")

    def cost(key: str, rows: DataFrame) -> DataFrame:
        """Pairs to compare in each unit: classes outside the main component times all."""
        k = rows.groupBy(key, "group", "comp").agg(F.count(F.lit(1)).alias("k"))
        return k.groupBy(key, "group").agg((F.sum("k") * (F.sum("k") - F.max("k"))).alias("pairs"))

    members = d.select(F.col("group").alias("unit"), "group", "digest", "comp", "size").distinct()
    apart = cost("bucket", d).groupBy("group").agg(F.sum("pairs").alias("apart"))
    joined = cost("unit", members).groupBy("group").agg(F.sum("pairs").alias("joined"))
    better = apart.join(joined, "group").select("group", (F.col("joined") <= F.col("apart")).alias("whole"))
    units = members.join(better.where("whole"), "group").select("unit", "digest", "comp", "size").unionByName(
        d.join(better.where("not whole"), "group").select(F.col("bucket").cast("string").cast("binary").alias("unit"), "digest", "comp", "size"))
    t = _blocks(units).join(sets, "digest")
    links = t.select("unit", "i", "j", "comp", "outside", "ids").groupBy("unit", "i", "j").applyInPandas(
        _crossing(num, den), "u binary, v binary")
    return links.distinct()


def _linked(docs: DataFrame, signed: DataFrame, num: int, den: int) -> DataFrame:
    """(digest, rep, root): every class with its least doc_id and its component."""
    classes = materialize(signed.where("n_shingles > 0").groupBy("digest", "n_shingles", "sig")
                          .agg(F.min("doc_id").alias("rep")), "dedup-classes")
    buckets = _buckets(classes)
    sets = _sets(docs, classes, buckets)
    links = materialize(verified(_spanning_pairs(buckets, classes, num, den), sets, num, den), "dedup-links")
    comps = connected_components(links)
    more = _crossing_links(buckets, classes, sets, comps, num, den)
    out = classes.join(comps, F.col("digest") == F.col("node"), "left").select(
        "digest", "rep", F.coalesce("root", "digest").alias("root"))
    if more is not None:  # components that belong together, by the least of their names
        further = connected_components(materialize(more, "dedup-more")).select(F.col("node").alias("root"), F.col("root").alias("_root"))
        out = out.join(further, "root", "left").select("digest", "rep", F.coalesce("_root", "root").alias("root"))
    return out


def near_duplicates(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id, kept.

    Links documents whose shingle sets have den * |intersection| >= num * |union|.
    """
    signed = materialize(signatures(docs), "dedup-signed")
    members = _linked(docs, signed, num, den)
    ids = members.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_class = members.join(ids, "root").select("digest", "component_id")
    return (signed.join(by_class, "digest", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def drop_near_duplicates(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component, one with the smallest doc_id (null last); rows unchanged.

    Rows are judged by doc_id and text, so different texts under one doc_id,
    or without one, are judged apart. Among rows of a component's smallest
    doc_id one text is chosen by its key, and any one row of that text stays.
    Rows without a word all stay.
    """
    signed = materialize(signatures(docs, keyed=True), "dedup-signed")
    members = _linked(docs, signed, num, den)
    found = materialize(signed.where("n_shingles > 0").join(members.select("digest", "root"), "digest")
                        .select("root", "doc_id", "_key"), "dedup-found")
    first = (found.groupBy("root").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("m"))
        .where("n > 1").select("root", F.col("m.doc_id").alias("_d"), F.col("m._key").alias("_k")))
    judged = materialize(found.join(first, "root").select(
        F.col("doc_id").alias("_t"), F.col("_key").alias("_x"),
        (F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k"))).alias("stays")), "dedup-judged")
    twice = materialize(judged.where("stays").groupBy("_t", "_x").agg(F.count(F.lit(1)).alias("n"))
                        .where("n > 1").select("_t", "_x"), "dedup-twice")
    gone = materialize(judged.where("not stays").select("_t", "_x").distinct(), "dedup-gone")
    side = F.broadcast(gone) if small_enough(gone.count(), 64) else gone
    same = F.col("_id").eqNullSafe(F.col("_t")) & (F.col("_key") == F.col("_x"))
    # names of docs can't clash
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), text_key().alias("_key"))
    rest = rows.join(side, same, "left_anti")
    if not twice.isEmpty():
        once = rest.join(twice, same, "left_semi").dropDuplicates(["_id", "_key"])
        rest = rest.join(twice, same, "left_anti").unionByName(once)
    return rest.select("_row.*")
