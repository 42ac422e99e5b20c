"""Session construction."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "sentiscope", cores: str | int | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the cluster's session.

    AQE is on so shuffle partitions coalesce at runtime and skewed joins split.
    The UI is off: no ports beyond what the driver needs.
    """
    cores = cores or os.environ.get("BENCH_CPUS") or "*"
    parts = shuffle_partitions or (int(cores) if str(cores).isdigit() else 8)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
