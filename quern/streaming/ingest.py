"""Structured Streaming extensions: a stream of changes into a stored table, and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.engine.session import Engine
from quern.sources import tables
from quern.sources.tables import OP, newest


def upsert_stream(engine: Engine, name: str, stream: DataFrame, checkpoint: str, order: str):
    """Start a query that writes every micro-batch as one version of a table; ``order`` decides between rows of one key."""
    t = engine.table(name)

    def write(batch: DataFrame, _: int) -> None:
        rows = newest(batch.withColumn(tables.VERSION, F.col(order).cast("long")), t.key).withColumn(OP, F.lit("put"))
        engine.commit_delta(t, rows.select(*t.columns(), OP))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums by event-time window and type; works on a stream and on a table."""
    rows = events.withWatermark("at", late) if events.isStreaming else events
    return rows.groupBy(F.window("at", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: events less than ``gap`` apart."""
    rows = events.withWatermark("at", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("at", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def event_rows(events: DataFrame) -> DataFrame:
    """events with a zoned time ``at`` and the value in whole cents, so that sums are exact."""
    return events.select("event_id", F.col("ts").cast("timestamp").alias("at"), "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))


def file_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
