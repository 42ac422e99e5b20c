"""Scored reviews computed once, kept in Parquet by category, and brought up to date by product.

Readers prune partitions by category and read only their columns. An update
scores the reviews of the changed products alone and replaces the partitions of
the categories that these products leave or enter; all others stay as they
are. New partitions are written beside the table first, so that nothing is read
and replaced in one job; an update that was broken off can be run again with
the same products.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialize

KEY, PARTITION = "product_id", "category"


class ScoredTable:
    """``score`` turns products into scored review rows, each with its product's key and category."""

    def __init__(self, spark: SparkSession, path: str, score: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.score = spark, path, score
        self.schema = None

    def build(self, products: DataFrame) -> None:
        """Score all products' reviews."""
        rows = self.score(products)
        self.schema = rows.schema
        rows.write.mode("overwrite").partitionBy(PARTITION).parquet(self.path)

    def read(self) -> DataFrame:
        """The table as ``score`` gave it; a filter on the category prunes partitions."""
        return self.spark.read.schema(self.schema).parquet(self.path).select(self.schema.names)

    def update(self, products: DataFrame, changed: DataFrame) -> list[str]:
        """Bring the rows of the ``changed`` keys in line with ``products``; returns the categories replaced.

        A changed key that ``products`` lacks loses its rows.
        """
        keys = changed.select(KEY).distinct()
        fresh = materialize(self.score(products.join(keys, KEY, "left_semi")), "scored-fresh")
        gone = self.read().join(keys, KEY, "left_semi")
        touched = gone.select(PARTITION).union(fresh.select(PARTITION)).distinct()
        names = sorted(r[PARTITION] for r in touched.collect())  # categories come from a fixed list
        if not names:
            return names
        rest = self.read().where(F.col(PARTITION).isin(names)).join(keys, KEY, "left_anti")
        rows = materialize(rest.unionByName(fresh), "scored-rows")
        left = {r[PARTITION] for r in rows.select(PARTITION).distinct().collect()}
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PARTITION).parquet(self.path)
        for name in set(names) - left:  # nothing was written there, so the old rows are still in place
            self._empty(name)
        return names

    def _empty(self, name: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        escaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{PARTITION}={escaped}")
        folder.getFileSystem(conf).delete(folder, True)
