"""Scans, predicates, joins, aggregation, sorting, set operations and subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.registry import Catalogue, table

C = Catalogue()


def money(x: str) -> str:
    """A DOUBLE money column as an exact decimal."""
    return f"CAST({x} AS DECIMAL(15,2))"


def total(x: str) -> str:
    """An exact sum, shown as DOUBLE."""
    return f"CAST(sum({x}) AS DOUBLE)"


REVENUE = f"{money('l_extendedprice')} * (1 - {money('l_discount')})"

# scans, projection, predicates
C.text("point_read", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 42")
C.text("narrow_scan_global_agg", f"SELECT count(*) AS n, {total(money('l_quantity'))} AS qty, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem WHERE l_quantity >= 10 AND l_discount < 0.05")
C.text("narrow_scan_group", f"SELECT l_returnflag, l_linestatus, count(*) AS n, {total(money('l_quantity'))} AS qty FROM lineitem WHERE l_quantity < 25 GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus")
C.text("project_alias_star", "SELECT n.*, n.n_nationkey + 100 AS shifted, upper(n_name) AS shout FROM nation n", "SELECT n.*, n.n_nationkey + 100 AS shifted, upper(n_name) AS shout FROM nation n")
C.text("filter_3vl", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT (l.toxic = 1) OR (l.quality = 1 AND l.toxic IS NULL)")
C.text("filter_in_list_null", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', NULL) AND o_orderkey NOT IN (1, 2, 3)")
C.text("filter_not_in_null_list", "SELECT count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', NULL)")
C.text("filter_between", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 20000 AND o_orderkey NOT BETWEEN 100 AND 200")
C.text("filter_like_ci", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'CUSTOMER#%1_' AND c_mktsegment NOT LIKE 'b%'", "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE 'CUSTOMER#%1_' AND c_mktsegment NOT ILIKE 'b%'")
C.text("case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'high' WHEN o_totalprice > 10000 THEN 'mid' END AS band FROM orders")
C.text("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM orders")
C.text("is_true_false", "SELECT d.doc_id, (l.toxic = 1) IS TRUE AS t, (l.toxic = 1) IS NOT TRUE AS nt, (l.toxic = 1) IS FALSE AS f, l.toxic IS NULL AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
C.text("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders ORDER BY o_orderstatus, o_orderpriority")
C.text("fromless_select", "SELECT CAST(1 AS BIGINT) AS one, 'x' AS x", "SELECT CAST(1 AS BIGINT) AS one, 'x' AS x")
C.text("derived_column_list", "SELECT q.k, q.n FROM (SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey) q (k, n) WHERE q.n > 5")
C.text("scan_partition_prune_dates", "SELECT count(*) AS n FROM orders WHERE o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1998-02-01'")

# joins
C.text("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000")
C.text("join_left_anti_pattern", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
C.text("join_right", "SELECT l.quality, d.doc_id FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id AND l.toxic = 1")
C.text("join_full", "SELECT a.k AS ak, b.k AS bk FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey < 200) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey BETWEEN 100 AND 300) b ON a.k = b.k")
C.text("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
C.text("join_comma", "SELECT r_name, n_name FROM region, nation WHERE n_regionkey = r_regionkey")
C.text("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
C.text("join_or_condition", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey OR (s_acctbal > 9000 AND n_nationkey = 0)")
C.text("join_self", "SELECT a.o_orderkey AS x, b.o_orderkey AS y FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey WHERE a.o_orderkey < 500")
C.text("join_natural", "SELECT doc_id, quality, source FROM labels NATURAL JOIN documents")
C.text("join_natural_full", "SELECT doc_id, x, y FROM (SELECT doc_id, quality AS x FROM labels WHERE quality = 0) a NATURAL FULL JOIN (SELECT doc_id, toxic AS y FROM labels WHERE toxic = 1) b")
C.text("join_using_full", "SELECT doc_id, a.x, b.y FROM (SELECT doc_id, quality AS x FROM labels WHERE quality = 0) a FULL JOIN (SELECT doc_id, toxic AS y FROM labels WHERE toxic = 1) b USING (doc_id)")
C.text("join_nested_tree", "SELECT c.c_custkey, o.o_orderkey, count(*) AS n FROM customer c LEFT JOIN (orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_quantity > 45) ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey, o.o_orderkey")
C.text("join_null_keys", "SELECT a.k, count(*) AS n FROM (SELECT nullif(o_orderstatus, 'F') AS k FROM orders WHERE o_orderkey < 300) a JOIN (SELECT DISTINCT nullif(o_orderstatus, 'F') AS k FROM orders) b ON a.k = b.k GROUP BY a.k")
C.text("join_mixed_numeric_keys", "SELECT n_nationkey, c_custkey FROM nation JOIN customer ON CAST(n_nationkey AS DOUBLE) = c_custkey")
C.text("join_string_keys", "SELECT a.o_orderkey, b.n FROM orders a JOIN (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY o_orderpriority) b ON a.o_orderpriority = b.p WHERE a.o_orderkey < 100")
C.text("join_bigint_precision", "SELECT a.k AS a, b.k AS b FROM (SELECT o_orderkey + 9007199254740992 AS k FROM orders WHERE o_orderkey < 50) a JOIN (SELECT o_orderkey + 9007199254740993 AS k FROM orders WHERE o_orderkey < 50) b ON a.k = b.k")

# the same joins without a range of ids, over whole tables
C.text("join_full_whole", "SELECT a.k AS ak, b.k AS bk FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') b ON a.k = b.k")
C.text("join_self_whole", "SELECT a.o_orderkey AS x, b.o_orderkey AS y FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey")
C.text("join_null_keys_whole", "SELECT a.k, count(*) AS n FROM (SELECT nullif(o_orderstatus, 'F') AS k FROM orders) a JOIN (SELECT DISTINCT nullif(o_orderstatus, 'F') AS k FROM orders) b ON a.k = b.k GROUP BY a.k")
C.text("join_string_keys_whole", "SELECT a.o_orderkey, b.n FROM orders a JOIN (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY o_orderpriority) b ON a.o_orderpriority = b.p")
C.text("join_bigint_precision_whole", "SELECT a.k AS a, b.k AS b FROM (SELECT o_orderkey + 9007199254740992 AS k FROM orders) a JOIN (SELECT o_orderkey + 9007199254740993 AS k FROM orders) b ON a.k = b.k")

# aggregation
Q1_SQL = f"""SELECT l_returnflag, l_linestatus, {total(money('l_quantity'))} AS sum_qty, {total(money('l_extendedprice'))} AS sum_base_price, {total(REVENUE)} AS sum_disc_price,
  CAST(sum({REVENUE} * (1 + {money('l_tax')})) AS DOUBLE) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-08-01 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus"""


@C.build(Q1_SQL)
def agg_tpch_q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = lambda c: F.col(c).cast("decimal(15,2)")
    disc = exact("l_extendedprice") * (1 - exact("l_discount"))
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2001-08-01 00:00:00").cast("timestamp_ntz"))
    return (
        rows.groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum(exact("l_quantity")).cast("double").alias("sum_qty"),
            F.sum(exact("l_extendedprice")).cast("double").alias("sum_base_price"),
            F.sum(disc).cast("double").alias("sum_disc_price"),
            F.sum(disc * (1 + exact("l_tax"))).cast("double").alias("sum_charge"),
            F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count(F.lit(1)).alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


C.text("agg_count_null", "SELECT count(*) AS n, count(l.toxic) AS labelled, sum(l.toxic) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", "SELECT count(*) AS n, count(l.toxic) AS labelled, CAST(sum(l.toxic) AS BIGINT) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
C.text("agg_distinct_all", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS c, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s, round(avg(DISTINCT o_custkey), 6) AS a, min(DISTINCT o_custkey) AS lo, max(DISTINCT o_custkey) AS hi FROM orders GROUP BY o_orderstatus")
C.text("agg_group_expr_ordinal", "SELECT o_custkey % 7 AS k, count(*) AS n FROM orders GROUP BY 1")
C.text("agg_having_alias", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING n > 8 AND max(o_totalprice) > 1000")
C.text("agg_having_without_group", "SELECT count(*) AS n FROM orders HAVING count(*) > 0")
C.text("agg_empty_global", "SELECT count(*) AS n, sum(o_totalprice) AS s, min(o_orderkey) AS lo, avg(o_totalprice) AS a FROM orders WHERE o_orderkey < 0")
C.text("agg_decimal_sum_avg", "SELECT o_orderstatus, CAST(CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DECIMAL(18,2)) AS DOUBLE) AS s, CAST(CAST(avg(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(18,6)) AS DOUBLE) AS a FROM orders GROUP BY o_orderstatus",
       "SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS s, CAST(CAST(floor((sum(CAST(o_totalprice AS DECIMAL(12,2))) * 100)::HUGEINT * 100000 / count(*) / 10 + 0.5) AS BIGINT) / 1000000 AS DOUBLE) AS a FROM orders GROUP BY o_orderstatus")
C.text("agg_null_group", "SELECT l.toxic AS k, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.toxic")
C.text("agg_min_max_types", "SELECT min(o_orderdate) AS d0, max(o_orderdate) AS d1, min(o_orderpriority) AS p0, max(o_orderpriority) AS p1, min(o_totalprice) AS t0 FROM orders")

# sort and limit
C.text("order_expr_alias_ordinal", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders ORDER BY twice DESC, 1 LIMIT 20")
C.text("order_nulls_first_last", "SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.toxic DESC NULLS FIRST, d.doc_id LIMIT 25")
C.text("order_default_nulls", "SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.toxic, d.doc_id LIMIT 25", "SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.toxic NULLS FIRST, d.doc_id LIMIT 25")
C.text("topk_tiebreak", "SELECT o_orderpriority, o_orderkey FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 15")
C.text("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10, 5", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 10")
C.text("limit_zero", "SELECT o_orderkey FROM orders LIMIT 0")

# set operations
C.text("union_all_widen", "SELECT CAST(n_nationkey AS DOUBLE) AS k FROM nation UNION ALL SELECT s_acctbal FROM supplier")
C.text("union_distinct", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
C.text("except_distinct", "SELECT o_custkey AS k FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 50000")
C.text("except_all", "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT o_custkey FROM orders WHERE o_totalprice > 50000")
C.text("intersect_distinct", "SELECT o_custkey AS k FROM orders WHERE o_totalprice > 50000 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
C.text("intersect_all", "SELECT o_custkey AS k FROM orders WHERE o_totalprice > 50000 INTERSECT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
C.text("setop_precedence", "SELECT n_regionkey AS k FROM nation WHERE n_nationkey < 3 UNION SELECT r_regionkey FROM region INTERSECT SELECT n_regionkey FROM nation WHERE n_nationkey > 20")
C.text("setop_branch_limit", "(SELECT o_orderkey AS k FROM orders ORDER BY o_orderkey LIMIT 3) UNION ALL (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 2)")

# subqueries and CTEs
C.text("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
C.text("scalar_subquery_empty", "SELECT n_nationkey, (SELECT o_orderkey FROM orders WHERE o_orderkey < 0) AS x FROM nation")
C.text("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
C.text("not_in_null", "SELECT count(*) AS n FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey > 2 THEN NULL ELSE r_regionkey END FROM region)")
C.text("not_in_plain", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 30000)")
C.text("exists_corr", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 90000)")
C.text("not_exists_residual", "SELECT o.o_orderkey FROM orders o WHERE o.o_orderkey < 2000 AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderkey <> o.o_orderkey AND p.o_totalprice > o.o_totalprice)")
C.text("not_exists_residual_whole", "SELECT o.o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderkey <> o.o_orderkey AND p.o_totalprice > o.o_totalprice)")
C.text("corr_scalar_avg", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(p.o_totalprice) * 1.3 FROM orders p WHERE p.o_custkey = o.o_custkey)")
C.text("corr_count_bug", "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 80000) AS n FROM customer c")
C.text("corr_in_select", "SELECT n_name, (SELECT count(*) FROM supplier s WHERE s.s_nationkey = n.n_nationkey) AS n_supp FROM nation n")
C.text("corr_in_having", "SELECT o_custkey, count(*) AS n FROM orders o GROUP BY o_custkey HAVING count(*) > (SELECT count(*) / 100 FROM supplier) + 8", "SELECT o_custkey, count(*) AS n FROM orders o GROUP BY o_custkey HAVING count(*) > (SELECT count(*) / 100 FROM supplier) + 8")
C.text("cte_column_list_twice", "WITH t (k, n) AS (SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey) SELECT a.k, a.n, b.n AS m FROM t a JOIN t b ON a.k = b.k + 1")
C.text("subquery_in_join_on", "SELECT n_name, s_suppkey FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)", "SELECT n_name, s_suppkey FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)) ON s_nationkey = n_nationkey")
