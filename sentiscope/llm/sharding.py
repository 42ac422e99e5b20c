"""Sharding by extendible hashing: buckets of a hash-prefix directory, split until they fit.

Every row has a 62-bit hash of its key. The directory starts at a common
depth d (bits of the prefix); a bucket whose rows exceed the byte limit is split
on the next bit, and only such a bucket, until every bucket fits. The shard of
a row is the leaf on its hash's path: its prefix, written in bits.

Sizes are summed once per fine cell (a prefix of more bits than any leaf is
likely to need) with partial aggregates; all depths' sums come from the cells.
Only rows of cells that are still too large are read again, with further bits.
So nothing is gathered by source or text, and a hot source spreads over all
buckets.

A key must be able to tell rows apart: rows with equal hashes can never be
split by a bit. Rows that are equal throughout are interchangeable; those of a
leaf of one single hash that exceeds the limit are dealt out to numbered parts
of that leaf, each within the limit. A single row larger than the limit is a
shard of its own, marked ``oversize``.

Edge cases: a null or empty text has 0 bytes; null keys hash like any value.
An empty table gives no shards. Working columns start with ``_sh_``; other
columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_enough

BITS = 62
CELL_BITS = 6  # bits of a cell beyond the depth at which buckets would fit on average
SHARD_BYTES = 8 * 1024 * 1024


def row_hash(keys: list[str]) -> Column:
    """Non-negative 62-bit hash."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - BITS)


def prefix(h: Column, bits: int) -> Column:
    """First ``bits`` bits of a hash, as a number."""
    return F.shiftright(h, BITS - bits)


def _leaves(cells: DataFrame, cell_bits: int, low: int, limit: int) -> DataFrame:
    """(cell, depth, leaf, leaf_bytes, open): the first depth from ``low`` on that ends the cell's path.

    A bucket ends there if it fits, or if all its rows have one hash, so that
    no bit can split it. ``open`` cells still hold several hashes and too many
    bytes at their full depth.
    """
    depth = F.explode(F.sequence(F.lit(low), F.lit(cell_bits)))
    each = cells.select("cell", "bytes", "least", "most", depth.alias("depth"))
    each = each.withColumn("leaf", F.expr(f"shiftright(cell, {cell_bits} - depth)"))
    sums = each.groupBy("depth", "leaf").agg(F.sum("bytes").alias("leaf_bytes"),
                                             (F.min("least") == F.max("most")).alias("one"))
    ends = (F.col("leaf_bytes") <= limit) | F.col("one")
    fit = (each.select("cell", "depth", "leaf")
           .join(sums.where(ends | (F.col("depth") == cell_bits)), ["depth", "leaf"])
           .groupBy("cell").agg(F.min(F.struct("depth", "leaf", "leaf_bytes", "one")).alias("x")))
    return fit.select("cell", "x.depth", "x.leaf", "x.leaf_bytes",
                      ((F.col("x.leaf_bytes") > limit) & ~F.col("x.one")).alias("open"))


def directory(rows: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """(bits, cell, depth, leaf, leaf_bytes): the leaf of every cell, for cells of ``bits`` bits.

    ``rows`` has _sh_h (hash) and _sh_b (bytes). A leaf that is still too
    large holds one single hash.
    """
    total = rows.agg(F.coalesce(F.sum("_sh_b"), F.lit(0)).alias("b")).first()["b"]
    fair = max(0, math.ceil(math.log2(max(1, total) / limit)))
    low, bits = max(0, fair - 1), min(BITS, fair + CELL_BITS)
    done, left = None, rows
    while True:
        cells = left.groupBy(prefix(F.col("_sh_h"), bits).alias("cell")).agg(
            F.sum("_sh_b").alias("bytes"), F.min("_sh_h").alias("least"), F.max("_sh_h").alias("most"))
        found = materialize(_leaves(cells, bits, low, limit).withColumn("bits", F.lit(bits)), "shard-directory")
        ready = found.where("not open")
        done = ready if done is None else done.unionByName(ready)
        still = found.where("open").select(F.col("cell").alias("_sh_cell"))
        n = still.count()
        if not n:
            return done.drop("open")
        side = F.broadcast(still) if small_enough(n, 16) else still
        left = left.join(side, prefix(F.col("_sh_h"), bits) == F.col("_sh_cell"), "left_semi")
        low, bits = bits, min(BITS, bits + CELL_BITS)


def _bits_text(leaf: Column, depth: Column) -> Column:
    """A leaf's prefix in bits; the whole space is '*'."""
    return F.when(depth == 0, "*").otherwise(F.lpad(F.bin(leaf), depth, "0"))


def assign_shards(df: DataFrame, keys: list[str], size: Column, limit: int = SHARD_BYTES) -> DataFrame:
    """``df`` with shard (prefix bits, then '.part' where a leaf has parts), depth and oversize."""
    marks = {"_sh_h": row_hash(keys), "_sh_b": size.cast("long")}
    rows = df.withColumns(marks)
    slim = rows.select("_sh_h", "_sh_b")
    leaves = materialize(directory(slim, limit), "shard-leaves")
    levels = [r["bits"] for r in leaves.select("bits").distinct().orderBy("bits").collect()]  # at most BITS / CELL_BITS
    n = leaves.count()
    out = None
    for bits in levels:  # each row meets the cell of its own level alone
        own = leaves.where(F.col("bits") == bits).select(F.col("cell").alias("_sh_cell"), "depth", "leaf", "leaf_bytes")
        side = F.broadcast(own) if small_enough(n, 48) else own
        part = rows.join(side, prefix(F.col("_sh_h"), bits) == F.col("_sh_cell")).drop("_sh_cell")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return df.withColumns({"shard": F.lit(None).cast("string"), "depth": F.lit(None).cast("int"),
                               "oversize": F.lit(None).cast("boolean")})
    name = _bits_text(F.col("leaf"), F.col("depth"))
    named = out.withColumn("shard", name)
    whole = F.col("leaf_bytes") <= limit
    fits = named.where(whole).withColumn("oversize", F.lit(False))
    if not leaves.where(F.col("leaf_bytes") > limit).isEmpty():
        fits = fits.unionByName(_dealt(named.where(~whole), df.columns, limit))
    return fits.select(*df.columns, "shard", "depth", "oversize")


def _dealt(rows: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """Rows of single-hash leaves over the limit, dealt out to parts within it.

    Rows that are equal throughout are counted, and each count is spread out
    again by part, so that neither their number nor their order in one place
    matters. Different rows of one hash get parts of their own.
    """
    kinds = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_sh_n"))
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("_sh_b", F.lit(1)))).cast("long")
    parts = (kinds.withColumn("_sh_each", each)
             .withColumn("_sh_k", F.row_number().over(Window.partitionBy("_sh_h").orderBy(F.xxhash64(*columns))))
             .withColumn("_sh_part", F.explode(F.expr("sequence(0L, (_sh_n - 1) div _sh_each)")))
             .repartition(F.col("_sh_h"), F.col("_sh_k"), F.col("_sh_part")))
    left = F.least(F.col("_sh_each"), F.col("_sh_n") - F.col("_sh_part") * F.col("_sh_each"))
    rowwise = parts.withColumn("_sh_left", left).withColumn("_sh_i", F.explode(F.expr("sequence(1L, _sh_left)")))
    return (rowwise.withColumn("shard", F.concat_ws(".", "shard", F.col("_sh_k").cast("string"), F.col("_sh_part").cast("string")))
            .withColumn("oversize", F.col("_sh_b") > limit).select(*rows.columns, "oversize"))


def shard_report(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """Per document: doc_id, bytes, shard, depth, oversize."""
    slim = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
                       F.xxhash64("text").alias("_text"))
    return assign_shards(slim, ["doc_id", "_text"], F.col("bytes"), limit).drop("_text")


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> None:
    """Write every shard to a folder of its own, ``shard=<bits>``, as one Parquet file.

    An input column named shard, depth or oversize is written as one of the
    struct ``row``, like all others.
    """
    rows = docs.select(F.struct("*").alias("row"))
    size = F.coalesce(F.octet_length("row.text"), F.lit(0))
    out = assign_shards(rows, ["row.doc_id", "row.text"], size, limit).drop("depth", "oversize")
    out.repartition("shard").write.partitionBy("shard").parquet(path)
