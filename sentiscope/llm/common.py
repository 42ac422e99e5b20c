"""Helpers that several operators share: table access, shared storage, safe columns."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space, as the operators' word definitions use it.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Longest key that a cache keeps.
LONGEST_KEY = 64
# Largest table that a caller may hint for broadcast, in bytes.
BROADCAST_BYTES = 32 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session that names none (tests) gets a scratch folder, once; on
    a cluster that is an error, since each executor would write to its own disk.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="llm-shared-"))
    return sc.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage: a lost executor costs only its own later tasks, and readers
    take only the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def text_key(col: str = "text") -> Column:
    """128 bits that stand for a text (null as empty), to tell rows of one doc_id apart."""
    return F.substring(F.unhex(F.sha2(text_or_empty(col), 256)), 1, 16)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def ws_words(c: Column) -> Column:
    """Words of a non-null string: maximal runs without ASCII white space."""
    trimmed = F.btrim(c, F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_RUN))


def small_enough(rows: int, row_bytes: int) -> bool:
    """Whether a table of so many rows of at most ``row_bytes`` may be broadcast."""
    return rows * row_bytes <= BROADCAST_BYTES


@contextmanager
def no_cycle_search() -> Iterator[None]:
    """Python's search for reference cycles walks every cache entry again and again; the loops
    that fill caches make no cycles, so it rests while one of them runs."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Cache(dict):
    """Values of ``make(key)`` with bounded memory: emptied when it holds ``size`` entries."""

    def __init__(self, make: Callable, size: int):
        super().__init__()
        self.make, self.size = make, size

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONGEST_KEY:
            if len(self) >= self.size:
                self.clear()
            self[key] = value
        return value
