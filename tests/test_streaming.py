import datetime as dt

from pyspark.sql import functions as F

from tallyhouse.operators.panel import keep_last
from tallyhouse.streaming import events as E


def drain(query_df, spark, name, mode="append"):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def write(spark, folder):
    t0 = dt.datetime(2024, 1, 1)
    for b in range(3):
        rows = [(b * 10 + i, t0 + dt.timedelta(minutes=b * 60 + i * 7), i % 2, float(i)) for i in range(10)]
        spark.createDataFrame(rows, "id long, ts timestamp, k int, v double").coalesce(1).write.mode("append").parquet(folder)


def test_streams_equal_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder)
    batch = spark.read.parquet(folder)
    want = {(r.start, r.k, r.n) for r in batch.groupBy(F.window("ts", "30 minutes").alias("w"), "k").agg(F.count("*").alias("n")).select("w.start", "k", "n").collect()}
    got = {(r.start, r.k, r.n) for r in drain(E.windowed_counts(E.event_stream(spark, folder), "ts", ["k"], "30 minutes", "2 hours"), spark, "win", "complete").collect()}
    assert got == want
    want = {(r.k, r.n) for r in batch.groupBy(F.session_window("ts", "20 minutes"), "k").agg(F.count("*").alias("n")).collect()}
    got = {(r.k, r.events) for r in drain(E.sessions(E.event_stream(spark, folder, 10), "ts", "k", "20 minutes", "2 hours"), spark, "ses", "complete").collect()}
    assert got == want
    assert drain(E.first_seen(E.event_stream(spark, folder), "ts", ["k"], "1 day"), spark, "first").count() == 2
    q = E.keep_last_table(E.event_stream(spark, folder), ["k"], ["ts", "id"], str(tmp_path / "t"), str(tmp_path / "c"))
    q.awaitTermination()
    assert {r.id for r in spark.read.parquet(str(tmp_path / "t/v0")).collect()} == {r.id for r in keep_last(batch, ["k"], [F.col("ts"), F.col("id")]).collect()}
