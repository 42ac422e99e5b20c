"""Streaming scoring of arriving reviews and event-time windows.

The batch and streaming forms share one function, so the batch query checks
the logic the stream runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.lexicons import SentimentResources
from ..operators.sentiment import score_full


def daily_event_windows(events: DataFrame, window: str = "1 day") -> DataFrame:
    """E2 (batch form): tumbling event-time windows, count and mean value per type."""
    g = events.groupBy(F.window("ts", window).alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("events"), F.bround(F.avg("value"), 6).alias("mean_value"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "event_type", "events", "mean_value")


def windowed_event_stream(spark: SparkSession, path: str, schema: StructType,
                          watermark: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Streaming tumbling windows; rows later than the watermark are dropped."""
    ev = spark.readStream.schema(schema).parquet(path).withWatermark("ts", watermark)
    return daily_event_windows(ev, window)


def sentiment_windows(scored: DataFrame, window: str = "1 day", time: str = "ts") -> DataFrame:
    """E2 over scored reviews: tumbling event-time windows, count and mean score per sentiment.

    Scores have four decimals; they are summed as whole ten-thousandths, so that no order changes a mean.
    """
    units = F.bround(F.col("compound") * 10000, 0).cast("long")
    g = scored.groupBy(F.window(time, window).alias("w"), "sentiment").agg(
        F.count(F.lit(1)).alias("reviews"), F.sum(units).alias("_units"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "sentiment", "reviews",
                    F.bround(F.col("_units") / F.col("reviews") / 10000, 6).alias("mean_compound"))


def sentiment_window_stream(spark: SparkSession, path: str, schema: StructType, watermark: str = "1 hour",
                            window: str = "1 day", time: str = "ts") -> DataFrame:
    """E2 behind E1: windows over the folder that ``score_review_stream`` fills, late rows dropped.

    Scoring is a stream of its own, so that this one's state is only the open
    windows' counts; ``schema`` is that of the scored rows.
    """
    rows = spark.readStream.schema(schema).parquet(f"{path}/epoch=*").withWatermark(time, watermark)
    return sentiment_windows(rows, window, time)


def score_review_stream(spark: SparkSession, path: str, schema: StructType,
                        res: SentimentResources, out_path: str, checkpoint: str,
                        keys: list[str], text_col: str = "review_text"):
    """Score each arriving micro-batch of review files, into ``out_path``/epoch=<id>.

    ``foreachBatch`` runs the batch scorer (joins + aggregation) per
    micro-batch and overwrites the folder of its epoch: a batch that a restart
    runs again replaces its own rows instead of adding them twice.
    """
    stream = spark.readStream.schema(schema).parquet(path)

    def write(batch: DataFrame, epoch_id: int) -> None:
        score_full(batch, keys, text_col, res).write.mode("overwrite").parquet(f"{out_path}/epoch={epoch_id}")

    return (stream.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
