"""Scalar semantics: one query for each function whose meaning needs care."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import scalar as S
from quern.plans.registry import Catalogue, table

C = Catalogue()


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


C.text("fn_division_null", "SELECT o_orderkey, o_custkey / (o_orderkey % 3) AS q, o_totalprice / 0 AS z FROM orders",
       "SELECT o_orderkey, CAST(o_custkey AS DOUBLE) / nullif(o_orderkey % 3, 0) AS q, CAST(NULL AS DOUBLE) AS z FROM orders")
C.text("fn_int_div_mod", "SELECT o_orderkey, (0 - o_custkey) DIV (o_orderkey % 4) AS d, (0 - o_custkey) % (o_orderkey % 5) AS m FROM orders",
       "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (0 - o_custkey) // (o_orderkey % 4) END AS d, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (0 - o_custkey) % (o_orderkey % 5) END AS m FROM orders")


@C.build("SELECT n_nationkey, CAST(n_nationkey AS BIGINT) + n_regionkey AS a, CAST(n_nationkey AS BIGINT) - n_regionkey AS b, CAST(n_nationkey AS BIGINT) * 3000000000 AS c, -CAST(n_nationkey AS BIGINT) AS d FROM nation")
def fn_int_widening(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", S.add(n, r).alias("a"), S.subtract(n, r).alias("b"), S.multiply(n, F.lit(3_000_000_000)).alias("c"), S.negate(n).alias("d"))


@C.build("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) + CAST(1.005 AS DECIMAL(5,3)) AS DOUBLE) AS s, CAST(CAST(o_totalprice AS DECIMAL(9,2)) * CAST(1.05 AS DECIMAL(3,2)) AS DOUBLE) AS p FROM orders")
def fn_decimal_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, one = F.col("o_totalprice"), F.lit("1.005").cast("decimal(5,3)")
    total = (price.cast("decimal(12,2)") + one).cast(S.decimal_type_of_sum(12, 2, 5, 3))
    product = (price.cast("decimal(9,2)") * F.lit("1.05").cast("decimal(3,2)")).cast(S.decimal_type_of_product(9, 2, 3, 2))
    return orders(spark, sf_dir).select("o_orderkey", total.cast("double").alias("s"), product.cast("double").alias("p"))


@C.build("""SELECT o_orderkey, CASE WHEN d = 0 THEN NULL ELSE CAST(sign(n) * floor((abs(n) * 2000000 + d) / (2 * d)) AS DOUBLE) / 1000000 END AS q FROM
  (SELECT o_orderkey, (CAST(round(o_totalprice * 100) AS HUGEINT) - 5000000) AS n, CAST(o_orderkey % 7 AS HUGEINT) * 100 AS d FROM orders)""".replace("floor((abs(n) * 2000000 + d) / (2 * d))", "((abs(n) * 2000000 + d) // (2 * nullif(d, 0)))"))
def fn_decimal_half_away(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("o_totalprice").cast("decimal(12,2)") - F.lit(50000).cast("decimal(7,2)")
    b = (F.col("o_orderkey") % 7).cast("decimal(5,2)")
    return orders(spark, sf_dir).select("o_orderkey", S.decimal_divide(a, b, 2).cast("double").alias("q"))


@C.build("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, CAST(length(text) AS BIGINT) AS chars FROM documents")
def fn_string_length_bytes_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.byte_length(F.col("text")).alias("bytes"), S.char_length(F.col("text")).alias("chars"))

C.text("fn_concat_null_bool", "SELECT d.doc_id, CONCAT(d.lang, '-', l.toxic = 1, d.doc_id) AS c, CONCAT(d.lang, NULL) AS z FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
       "SELECT d.doc_id, CASE WHEN l.toxic IS NULL THEN NULL ELSE d.lang || '-' || CASE WHEN l.toxic = 1 THEN '1' ELSE '0' END || CAST(d.doc_id AS VARCHAR) END AS c, CAST(NULL AS VARCHAR) AS z FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")


C.text("fn_substring_edges", """SELECT c_custkey, SUBSTRING(c_name, 0, 2) AS z, SUBSTRING(c_name, 3, 4) AS a, SUBSTR(c_name, -3, 3) AS b, SUBSTRING(c_name, -90, 90) AS e, SUBSTRING(c_name, 2, -1) AS n,
  SUBSTRING(c_name, c_custkey % 5, c_custkey % 4) AS v, SUBSTRING(c_name FROM 3 FOR 4) AS f FROM customer""",
       """SELECT c_custkey, '' AS z, substr(c_name, 3, 4) AS a, right(c_name, 3) AS b, c_name AS e, '' AS n,
  CASE WHEN c_custkey % 5 = 0 OR c_custkey % 4 = 0 THEN '' ELSE substr(c_name, c_custkey % 5, c_custkey % 4) END AS v, substr(c_name, 3, 4) AS f FROM customer""")


C.text("fn_date_interval_clamp", "SELECT DISTINCT o_orderdate, o_orderdate + INTERVAL '1' MONTH AS m, o_orderdate - INTERVAL '1' YEAR AS y, o_orderdate + INTERVAL '90' DAY AS d, DATE('2024-01-31') + INTERVAL '1' MONTH AS c FROM orders",
       "SELECT DISTINCT o_orderdate, o_orderdate + INTERVAL 1 MONTH AS m, o_orderdate - INTERVAL 1 YEAR AS y, o_orderdate + INTERVAL 90 DAY AS d, TIMESTAMP '2024-02-29 00:00:00' AS c FROM orders")


@C.build("SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, CAST(extract(month FROM o_orderdate) AS BIGINT) AS m, CAST(extract(day FROM o_orderdate) AS BIGINT) AS d FROM orders")
def fn_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("o_orderdate")
    return orders(spark, sf_dir).select("o_orderkey", *[S.extract(p, ts).alias(a) for p, a in (("YEAR", "y"), ("MONTH", "m"), ("DAY", "d"))])


C.text("fn_cast_round", "SELECT o_orderkey, CAST(o_orderkey / 2.0 - 100 AS SIGNED) AS f, CAST(CAST(o_orderkey / 2.0 - 100 AS DECIMAL(12,1)) AS BIGINT) AS d, CAST(CONCAT('  ', o_orderkey, ' ') AS SIGNED) AS s FROM orders",
       "SELECT o_orderkey, CAST(sign(x) * floor(abs(x) + 0.5) AS BIGINT) AS f, CAST(sign(x) * floor(abs(x) + 0.5) AS BIGINT) AS d, o_orderkey AS s FROM (SELECT o_orderkey, o_orderkey / 2.0 - 100 AS x FROM orders)")


C.text("fn_cast_bool_string", """SELECT o_orderkey, CAST(o_orderstatus = 'F' AS CHAR) AS b, CAST(o_orderdate AS CHAR) AS t, CAST(o_custkey % 2 AS BOOLEAN) AS n,
  CAST(CASE WHEN o_orderstatus = 'F' THEN 'TRUE' ELSE ' 0 ' END AS BOOLEAN) AS s, CAST('yes' AS BOOLEAN) AS y FROM orders""",
       "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END AS b, CAST(epoch_us(o_orderdate) AS VARCHAR) AS t, o_custkey % 2 <> 0 AS n, CASE WHEN o_orderstatus = 'F' THEN true ELSE false END AS s, CAST(NULL AS BOOLEAN) AS y FROM orders")


C.text("fn_coalesce_family", "SELECT d.doc_id, coalesce(l.toxic, l.quality, 9) AS c, ifnull(l.toxic, -1) AS i, nullif(l.quality, 1) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
C.text("fn_abs_upper_lower", "SELECT c_custkey, abs(c_acctbal) AS a, ucase(c_name) AS u, lcase(c_mktsegment) AS l FROM customer")
C.text("fn_date_literal", "SELECT count(*) AS n FROM orders WHERE o_orderdate >= DATE '1997-06-15' AND o_orderdate < DATE '1997-06-15' + INTERVAL '3' MONTH")


@C.build("SELECT event_id, epoch_us(ts) AS us, epoch_us(ts) % 1000000 AS frac FROM events")
def fn_timestamp_micros(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = S.micros(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", us.alias("us"), S.modulo(us, F.lit(1_000_000)).cast("bigint").alias("frac"))
