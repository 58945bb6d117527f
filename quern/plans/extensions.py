"""Streaming extensions, beyond the compared engine's surface."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.engine.session import Engine
from quern.plans.registry import Catalogue, table
from quern.sources.stage import stage, stage_root
from quern.streaming import ingest

C = Catalogue()


@C.build("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2")
def ext_tumbling_window_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ingest.tumbling(ingest.event_rows(table(spark, sf_dir, "events")))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "cents")


@C.build("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
  (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def ext_session_window_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ingest.sessions(ingest.event_rows(table(spark, sf_dir, "events")))
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@C.build("SELECT user_id AS id, max(event_id) AS event_id FROM events GROUP BY user_id")
def ext_stream_delta_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of every user, kept by a stream of upserts."""
    e = Engine(spark)
    e.execute("CREATE TABLE last_event (id BIGINT PRIMARY KEY, event_id BIGINT NOT NULL)")
    rows = stage(table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id"), "stream")
    path = rows.inputFiles()[0].rsplit("/", 1)[0]
    ingest.upsert_stream(e, "last_event", ingest.file_stream(spark, path, rows.schema), f"{stage_root(spark)}/stream-{uuid.uuid4().hex}", "event_id").awaitTermination()
    return e.execute("SELECT id, event_id FROM last_event")
