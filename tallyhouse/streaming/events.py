"""Structured Streaming forms: windows over late events, first sightings, sessions, keep-last tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A stream over a growing folder of Parquet files; its schema is that of the files there now."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(events: DataFrame, at: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts per tumbling window; events later than ``late`` behind the newest are dropped."""
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return e.groupBy(F.window(at, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", *keys, "n")


def sessions(events: DataFrame, at: str, key: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key: events not more than ``gap`` apart."""
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    s = e.groupBy(F.session_window(at, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("events"), F.max(at).alias("last"))
    return s.select(key, F.col("s.start").alias("start"), "last", "events")


def first_seen(events: DataFrame, at: str, keys: list[str], late: str) -> DataFrame:
    """Each key once within the time that late events may take."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def keep_last_table(events: DataFrame, keys: list[str], order: list[str], table: str, checkpoint: str) -> StreamingQuery:
    """Keeps the last row per key in a Parquet table that each batch replaces: a journal whose later lines win."""
    from tallyhouse.operators.panel import keep_last

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = f"{table}/v{batch_id % 2}"
        was = f"{table}/v{(batch_id + 1) % 2}"
        old = spark.read.schema(batch.schema).parquet(was) if batch_id else batch.limit(0)
        keep_last(old.unionByName(batch), keys, [F.col(c) for c in order]).write.mode("overwrite").parquet(now)

    return events.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
