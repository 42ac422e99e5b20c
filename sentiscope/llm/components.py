"""Distributed connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): each directed edge with the least node around u, u itself included.

    The least is a partial aggregate and comes back by an equi-join, so the
    neighbours of one node are never gathered in one place.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("x")).select(
        F.col("u").alias("_u"), F.least("u", "x").alias("m"))
    return edges.join(least, F.col("u") == F.col("_u")).drop("_u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    d = _with_least(down)
    return (d.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(d.select("u", F.col("m").alias("v"))).where("u > v").distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``edges(u, v)``; root is its component's least node.

    Nulls and loops carry no link and are left out: a node only in loops gets
    no row. Each round is written to the shared folder; rounds end when the
    edge set stops changing, after a number that grows with the logarithm of
    the component size.
    """
    e = edges.select("u", "v").where("u is not null and v is not null and u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    mark = None
    while True:
        e = materialize(_small_star(_large_star(e).distinct()), "components")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())
        if now == mark or not now[0]:
            break
        mark = now
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
