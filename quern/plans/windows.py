"""Window functions; partitions and orders are over unique keys, so results do not depend on input order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.scalar import micros
from quern.plans.registry import Catalogue, table

C = Catalogue()

C.text("win_rank_family", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS rn, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS dr FROM orders",
       "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS rn, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS INTEGER) AS rk, CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS INTEGER) AS dr FROM orders")
C.text("win_ntile", "SELECT o_orderkey, CAST(ntile(7) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS BIGINT) AS b FROM orders")
C.text("win_lag_lead_default", "SELECT o_orderkey, lag(o_totalprice, 2, 0.0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS two_before, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), o_custkey) AS after FROM orders",
       "SELECT o_orderkey, lag(o_totalprice, 2, 0.0::DOUBLE) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS two_before, lead(o_orderkey, 1, o_custkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM orders")
C.text("win_first_last_frames", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING)")
C.text("win_rows_frames", "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS n FROM orders")
C.text("win_rows_frame_empty", "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 50 PRECEDING AND 40 PRECEDING) AS BIGINT) AS s, count(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 50 PRECEDING AND 40 PRECEDING) AS n FROM orders")
C.text("win_range_peer", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM orders")
C.text("win_range_value", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY user_id RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n, CAST(sum(event_id) OVER (PARTITION BY event_type ORDER BY user_id RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS s FROM events")
C.text("win_desc_nulls", "SELECT d.doc_id, row_number() OVER (ORDER BY l.toxic DESC, d.doc_id) AS rn FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
       "SELECT d.doc_id, CAST(row_number() OVER (ORDER BY l.toxic DESC NULLS LAST, d.doc_id) AS INTEGER) AS rn FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
C.text("win_null_partition", "SELECT d.doc_id, count(*) OVER (PARTITION BY l.toxic) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
C.text("win_over_group_by", "SELECT o_custkey, count(*) AS n, rank() OVER (ORDER BY count(*) DESC, o_custkey) AS r FROM orders GROUP BY o_custkey",
       "SELECT o_custkey, count(*) AS n, CAST(rank() OVER (ORDER BY count(*) DESC, o_custkey) AS INTEGER) AS r FROM orders GROUP BY o_custkey")
C.text("win_running_sum_default_frame", "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS DOUBLE) AS s, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) OVER (PARTITION BY o_custkey) AS DOUBLE) AS w FROM orders")
C.text("win_min_max_avg", "SELECT o_orderkey, min(o_totalprice) OVER (PARTITION BY o_custkey) AS lo, max(o_totalprice) OVER (PARTITION BY o_custkey) AS hi, round(avg(o_orderkey) OVER (PARTITION BY o_custkey), 6) AS a FROM orders")


@C.build("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events")
def win_range_timestamp_micros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of a timestamp key in integer microseconds."""
    w = Window.partitionBy("user_id").orderBy(micros(F.col("ts"))).rangeBetween(-3_600_000_000, 0)
    return table(spark, sf_dir, "events").select("event_id", F.count(F.lit(1)).over(w).alias("n"))
