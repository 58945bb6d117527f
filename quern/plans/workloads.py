"""The 22 decision-support shapes, the 9 comparison queries and order-entry shapes, on the given tables."""

from __future__ import annotations

from quern.plans.registry import Catalogue
from quern.plans.relational import Q1_SQL, REVENUE, money, total

C = Catalogue()

PARTSUPP = f"SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, count(*) AS ps_availqty, min({money('l_extendedprice')}) AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey"


def share(a: str, b: str, digits: int = 6) -> str:
    return f"round(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), {digits})"


H = {
    1: Q1_SQL,
    2: f"WITH ps AS ({PARTSUPP}) SELECT s_acctbal, s_name, n_name, p_partkey FROM part, supplier, ps, nation, region WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_type = 'PROMO' AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE' AND ps_supplycost = (SELECT min(ps_supplycost) FROM ps, supplier, nation, region WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE') ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100",
    3: f"SELECT l_orderkey, {total(REVENUE)} AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10",
    4: "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-07-01' + INTERVAL '3' MONTH AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL '60' DAY) GROUP BY o_orderpriority ORDER BY o_orderpriority",
    5: f"SELECT n_name, {total(REVENUE)} AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01' GROUP BY n_name ORDER BY revenue DESC",
    6: f"SELECT {total(money('l_extendedprice') + ' * ' + money('l_discount'))} AS revenue FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24",
    7: f"SELECT supp_nation, cust_nation, l_year, {total('volume')} AS revenue FROM (SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(YEAR FROM l_shipdate) AS BIGINT) AS l_year, {REVENUE} AS volume FROM supplier, lineitem, orders, customer, nation n1, nation n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND ((n1.n_name = 'NATION_6' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_6'))) shipping GROUP BY supp_nation, cust_nation, l_year",
    8: f"SELECT o_year, {share('sum(CASE WHEN nation = ' + chr(39) + 'NATION_2' + chr(39) + ' THEN volume ELSE 0 END)', 'sum(volume)')} AS mkt_share FROM (SELECT CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS o_year, {REVENUE} AS volume, n2.n_name AS nation FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND o_orderdate BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND p_type = 'ECONOMY') all_nations GROUP BY o_year",
    9: f"WITH ps AS ({PARTSUPP}) SELECT nation, o_year, {total('amount')} AS sum_profit FROM (SELECT n_name AS nation, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS o_year, {REVENUE} - ps_supplycost * {money('l_quantity')} AS amount FROM part, supplier, lineitem, ps, orders, nation WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name ILIKE '%ring%') profit GROUP BY nation, o_year",
    10: f"SELECT c_custkey, c_name, {total(REVENUE)} AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1996-10-01' + INTERVAL '3' MONTH AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20",
    11: f"WITH ps AS ({PARTSUPP}) SELECT ps_partkey, {total('ps_supplycost * ps_availqty')} AS value FROM ps, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7' GROUP BY ps_partkey HAVING sum(ps_supplycost * ps_availqty) > (SELECT sum(ps_supplycost * ps_availqty) * 0.001 FROM ps, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7')",
    12: "SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count, CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' GROUP BY l_linestatus",
    13: "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT ILIKE '%URGENT%' GROUP BY c_custkey) c_orders GROUP BY c_count ORDER BY custdist DESC, c_count DESC",
    14: f"SELECT {share('100 * sum(CASE WHEN p_type ILIKE ' + chr(39) + 'PROMO%' + chr(39) + ' THEN ' + REVENUE + ' ELSE 0 END)', 'sum(' + REVENUE + ')')} AS promo_revenue FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1997-09-01' AND l_shipdate < DATE '1997-10-01'",
    15: f"WITH revenue (supplier_no, total_revenue) AS (SELECT l_suppkey, sum({REVENUE}) FROM lineitem WHERE l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1998-01-01' + INTERVAL '3' MONTH GROUP BY l_suppkey) SELECT s_suppkey, s_name, CAST(total_revenue AS DOUBLE) AS total_revenue FROM supplier, revenue WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue)",
    16: f"WITH ps AS ({PARTSUPP}) SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM ps, part WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#5' AND p_type NOT ILIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9) AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size",
    17: f"SELECT {share('sum(' + money('l_extendedprice') + ')', '7.0')} AS avg_yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity < (SELECT 0.2 * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)",
    18: f"SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, {total(money('l_quantity'))} AS qty FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250) AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100",
    19: f"SELECT {total(REVENUE)} AS revenue FROM lineitem, part WHERE (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 30 AND p_size BETWEEN 1 AND 25) OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 40 AND p_size BETWEEN 1 AND 40)",
    20: f"WITH ps AS ({PARTSUPP}) SELECT s_suppkey, s_name FROM supplier, nation WHERE s_suppkey IN (SELECT ps_suppkey FROM ps WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name ILIKE 'small%') AND ps_availqty * 100 > (SELECT 0.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1999-01-01')) AND s_nationkey = n_nationkey ORDER BY s_suppkey",
    21: "SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders, nation WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate + INTERVAL '60' DAY AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R') AND s_nationkey = n_nationkey GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100",
    22: f"SELECT cntrycode, count(*) AS numcust, {total('bal')} AS totacctbal FROM (SELECT substring(c_mktsegment, 1, 2) AS cntrycode, {money('c_acctbal')} AS bal FROM customer WHERE substring(c_mktsegment, 1, 2) IN ('AU', 'BU', 'MA') AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '2001-06-01')) custsale GROUP BY cntrycode",
}
for number, text in H.items():
    C.text(f"tpch_q{number:02d}", text)

B = {
    1: "SELECT count(*) AS n FROM orders",
    2: f"SELECT {total(money('o_totalprice'))} AS s FROM orders WHERE o_orderstatus = 'F'",
    3: f"SELECT o_orderpriority, count(*) AS n, {total(money('o_totalprice'))} AS s FROM orders GROUP BY o_orderpriority",
    4: f"SELECT o_orderpriority, o_orderstatus, count(*) AS n, {total(money('o_totalprice'))} AS s FROM orders WHERE o_totalprice > 20000 GROUP BY o_orderpriority, o_orderstatus",
    5: f"SELECT o_custkey, {total(money('o_totalprice'))} AS s FROM orders GROUP BY o_custkey ORDER BY s DESC, o_custkey LIMIT 10",
    6: f"SELECT count(*) AS n, {total(money('o_totalprice'))} AS s FROM orders WHERE o_orderkey BETWEEN 5000 AND 14999",
    7: f"SELECT count(*) AS n, {total(money('o_totalprice'))} AS s FROM orders WHERE o_orderdate >= DATE '1998-05-01' AND o_orderdate < DATE '1998-05-31'",
    8: "SELECT count(DISTINCT o_custkey) AS n FROM orders",
    9: f"SELECT c_mktsegment, count(*) AS n, {total(money('o_totalprice'))} AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
}
for number, text in B.items():
    C.text(f"bench_q{number}", text)

# order entry: stock level and consistency conditions on derived tables
C.text("tpcc_stock_level_shape", "SELECT count(DISTINCT l_partkey) AS low_stock FROM lineitem JOIN (SELECT ps_partkey, CAST(sum(ps_availqty) AS BIGINT) AS stock FROM (" + PARTSUPP + ") p GROUP BY ps_partkey) s ON s.ps_partkey = l_partkey WHERE l_orderkey BETWEEN 1000 AND 1020 AND stock < 40")
C.text("tpcc_consistency_shapes", f"SELECT count(*) AS customers, CAST(sum(CASE WHEN a.n = b.n AND a.s = b.s THEN 0 ELSE 1 END) AS BIGINT) AS broken FROM (SELECT c_custkey AS k, count(o_orderkey) AS n, coalesce(sum({money('o_totalprice')}), 0) AS s FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) a JOIN (SELECT c_custkey AS k, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, coalesce((SELECT sum({money('o_totalprice')}) FROM orders WHERE o_custkey = c_custkey), 0) AS s FROM customer) b ON a.k = b.k")
C.text("tpcc_order_status_shape", "SELECT o.o_custkey, o.o_orderkey, l.l_linenumber, l.l_partkey, l.l_quantity FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_custkey = 37 AND o.o_orderkey = (SELECT max(p.o_orderkey) FROM orders p WHERE p.o_custkey = 37)")
C.text("tpcc_max_order_per_customer", "SELECT o_custkey, max(o_orderkey) AS last_order, count(*) AS orders_n, count(*) = count(DISTINCT o_orderkey) AS distinct_keys FROM orders GROUP BY o_custkey")
