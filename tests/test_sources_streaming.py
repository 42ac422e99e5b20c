"""CSV reading (S1-S3) and the streaming path."""
import os
import tempfile

from pyspark.sql import functions as F

from sentiscope.functions.lexicons import fixture_resources
from sentiscope.sources.csv import read_product_csv, with_product_id
from sentiscope.sources.scored import ScoredTable
from sentiscope.streaming.events import (
    daily_event_windows,
    score_review_stream,
    sentiment_window_stream,
    sentiment_windows,
    windowed_event_stream,
)


def test_csv_quotes_newlines_and_na(spark):
    d = tempfile.mkdtemp(prefix="sentiscope-csv-")
    path = os.path.join(d, "p.csv")
    with open(path, "w") as f:
        f.write(',title,price,os\n0,"a ""quoted""\nname",N/A, N/A\n1,b,₹10,nan\n')
    df = with_product_id(read_product_csv(spark, path))
    rows = sorted(df.collect(), key=lambda r: r["product_id"])
    assert rows[0]["title"] == 'a "quoted"\nname'
    assert rows[0]["price"] is None and rows[0]["os"] == " N/A"
    assert rows[1]["os"] is None and len(rows) == 2


def test_stream_scores_arriving_files(spark):
    d = tempfile.mkdtemp(prefix="sentiscope-stream-")
    src, out, ck = (os.path.join(d, x) for x in ("in", "out", "ck"))
    spark.createDataFrame([(1, "this is with it"), (2, "was from by")],
                          "review_id long, review_text string").write.parquet(src)
    schema = spark.read.parquet(src).schema
    q = score_review_stream(spark, src, schema, fixture_resources(spark), out, ck, ["review_id"])
    q.awaitTermination(120)
    got = {r["review_id"]: r["sentiment"] for r in spark.read.parquet(out).collect()}
    assert got == {1: "Positive", 2: "Negative"}


def test_a_batch_that_runs_again_adds_no_rows(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    spark.createDataFrame([(1, "this is with it"), (2, "was from by")],
                          "review_id long, review_text string").write.parquet(src)
    schema = spark.read.parquet(src).schema
    for _ in range(2):
        score_review_stream(spark, src, schema, fixture_resources(spark), out, ck, ["review_id"]).awaitTermination(120)
        for name in os.listdir(os.path.join(ck, "commits")):  # as if it had stopped before the commit
            if name.startswith((".0", "0")):
                os.remove(os.path.join(ck, "commits", name))
    assert sorted(r["review_id"] for r in spark.read.parquet(out).collect()) == [1, 2]


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    src = str(tmp_path / "events")

    def add(*rows):
        df = spark.createDataFrame(list(rows), "ts string, event_type string, value double")
        df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(src)

    add(("2024-01-01 10:00:00", "a", 1.0), ("2024-01-03 10:00:00", "a", 5.0))
    out = windowed_event_stream(spark, src, spark.read.parquet(src).schema)
    q = out.writeStream.outputMode("append").format("memory").queryName("late_events").start()
    try:
        q.processAllAvailable()
        add(("2024-01-01 12:00:00", "a", 100.0), ("2024-01-05 10:00:00", "a", 7.0))  # the first is late
        q.processAllAvailable()
        add(("2024-01-09 10:00:00", "a", 9.0))
        q.processAllAvailable()
        got = {str(r["window_start"])[:10]: (r["events"], r["mean_value"]) for r in spark.table("late_events").collect()}
    finally:
        q.stop()
    assert got["2024-01-01"] == (1, 1.0) and got["2024-01-03"] == (1, 5.0) and got["2024-01-05"] == (1, 7.0)


def test_scored_reviews_in_windows_equal_the_batch(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    texts = ["this is with it", "was from by", "nothing here", "this at be", "from are"]

    def add(*rows):
        df = spark.createDataFrame(list(rows), "review_id long, ts string, review_text string")
        df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(src)

    def arrive(*rows):
        add(*rows)
        score_review_stream(spark, src, spark.read.parquet(src).schema, fixture_resources(spark), out, ck,
                            ["review_id"]).awaitTermination(120)

    first = [(i, f"2024-01-0{1 + i % 3} {i % 24:02d}:00:00", texts[i % 5]) for i in range(20)]
    arrive(*first)
    scored = spark.read.parquet(out).drop("epoch")
    stream = sentiment_window_stream(spark, out, scored.schema)
    q = stream.writeStream.outputMode("append").format("memory").queryName("moods").start()
    try:
        q.processAllAvailable()
        arrive((50, "2024-01-01 01:00:00", texts[0]), (51, "2024-01-06 01:00:00", texts[1]))  # the first is late
        q.processAllAvailable()
        arrive((60, "2024-01-20 01:00:00", texts[0]))
        q.processAllAvailable()
        got = {tuple(r) for r in spark.table("moods").collect()}
    finally:
        q.stop()
    on_time = spark.read.parquet(out).where("review_id not in (50, 60)")
    assert got == {tuple(r) for r in sentiment_windows(on_time).collect()}


def test_scored_table_follows_its_products(spark, tmp_path):
    def products(rows):
        return spark.createDataFrame(rows, "product_id long, category string, mood double")

    calls = []

    def score(p):
        calls.append(sorted(r["product_id"] for r in p.select("product_id").collect()))
        return p.select("product_id", F.col("mood").alias("compound"), "category", F.lit("x & y = z").alias("note"))

    old = [(1, "A & B", 0.1), (2, "A & B", 0.2), (3, "C", 0.3), (4, "D/E", 0.4)]
    t = ScoredTable(spark, str(tmp_path / "scored"), score)
    t.build(products(old))
    assert t.read().columns == ["product_id", "compound", "category", "note"]
    new = [(1, "A & B", 0.9), (2, "C", 0.2), (3, "C", 0.3), (5, "F", 0.5)]  # 4 is gone, its category with it
    changed = spark.createDataFrame([(1,), (2,), (4,), (5,)], "product_id long")
    assert t.update(products(new), changed) == ["A & B", "C", "D/E", "F"]
    assert calls[1:] == [[1, 2, 5]]
    assert sorted(tuple(r)[:3] for r in t.read().collect()) == [(1, 0.9, "A & B"), (2, 0.2, "C"), (3, 0.3, "C"), (5, 0.5, "F")]
    assert t.read().where("category = 'D/E'").count() == 0
    assert t.update(products(new), changed.where("false")) == []
    plan = t.read().where("category = 'C'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(category" in plan


def test_event_windows_daily(spark):
    ev = spark.createDataFrame([("2024-01-01 01:00:00", "a", 1.0), ("2024-01-01 23:00:00", "a", 3.0),
                                ("2024-01-02 00:00:00", "a", 5.0)], "ts string, event_type string, value double")
    ev = ev.withColumn("ts", F.to_timestamp("ts"))
    got = sorted((str(r["window_start"])[:10], r["events"], r["mean_value"]) for r in daily_event_windows(ev).collect())
    assert got == [("2024-01-01", 2, 2.0), ("2024-01-02", 1, 5.0)]
