"""Stored tables: changes, snapshots, sessions, partitions, statistics, files; and recursive queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.engine.session import Engine
from quern.plans.registry import Catalogue, run_sql, table
from quern.sources import files, tables
from quern.sources.stage import stage_root
from quern.sources.tables import ListPart, Partitioning, RangePart

C = Catalogue()


def customers(spark: SparkSession, sf_dir: str, partitioning: Partitioning | None = None) -> Engine:
    """An engine with the table cust(k, nation, balance, segment)."""
    e = Engine(spark)
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("bigint").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    e.register("cust", rows, ["k"] + (["nation"] if partitioning else []), partitioning)
    return e


CUST = "SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer"


@C.build(f"SELECT * FROM ({CUST}) WHERE k NOT IN (1, 2) UNION ALL VALUES (1, 7, 1.5::DOUBLE, 'NEW'), (2, NULL, 2.5, NULL), (1000001, 3, -1.0, 'NEW')")
def dml_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = customers(spark, sf_dir)
    e.execute("INSERT INTO cust (k, nation, balance, segment) VALUES (1, 7, 1.5, 'NEW'), (2, NULL, 2.5, NULL), (1000001, 3, -1.0, 'NEW')")
    return e.execute("SELECT * FROM cust")


@C.build(f"WITH c AS ({CUST}) SELECT * FROM c UNION ALL SELECT k + 5000000, nation, balance, segment FROM c WHERE balance > 9000")
def dml_insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = customers(spark, sf_dir)
    e.execute("INSERT INTO cust SELECT k + 5000000, nation, balance, segment FROM cust WHERE balance > 9000")
    return e.execute("SELECT * FROM cust")


@C.build(f"WITH c AS ({CUST}) SELECT k, CASE WHEN nation < 5 THEN nation + 100 ELSE nation END AS nation, CASE WHEN nation < 5 THEN CAST(nation + 100 AS DOUBLE) * 2 ELSE balance END AS balance, segment FROM c")
def dml_update_left_to_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = customers(spark, sf_dir)
    e.execute("UPDATE cust SET nation = nation + 100, balance = nation * 2 WHERE nation < 5")
    return e.execute("SELECT * FROM cust")


@C.build(f"SELECT * FROM ({CUST}) WHERE NOT (balance < 0 OR segment ILIKE 'b%')")
def dml_delete_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = customers(spark, sf_dir)
    e.execute("DELETE FROM cust WHERE balance < 0 OR segment LIKE 'B%'")
    return e.execute("SELECT * FROM cust")


@C.build("SELECT CAST(0 AS BIGINT) AS n")
def dml_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = customers(spark, sf_dir)
    e.execute("TRUNCATE TABLE cust")
    return e.execute("SELECT count(*) AS n FROM cust")


@C.build(f"SELECT * FROM ({CUST})")
def snapshot_read_old_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = customers(spark, sf_dir)
    reader = e.session()
    reader.execute("START TRANSACTION READ ONLY")
    e.execute("UPDATE cust SET balance = 0")
    e.execute("DELETE FROM cust WHERE k < 100")
    return reader.execute("SELECT * FROM cust")


@C.build(f"SELECT k, nation, balance + 1 AS balance, segment FROM ({CUST}) WHERE k > 10 UNION ALL VALUES (2000000, 1, 1.0::DOUBLE, 'MINE')")
def session_read_own_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = customers(spark, sf_dir).session()
    s.execute("BEGIN")
    s.execute("UPDATE cust SET balance = balance + 1")
    s.execute("DELETE FROM cust WHERE k <= 10")
    s.execute("INSERT INTO cust VALUES (2000000, 1, 1.0, 'MINE')")
    return s.execute("SELECT * FROM cust")


@C.build(f"SELECT * FROM ({CUST}) WHERE k % 10 <> 3 UNION ALL SELECT k, nation, 0.5::DOUBLE, segment FROM ({CUST}) WHERE k % 10 = 3 AND k % 20 <> 3")
def base_delta_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A columnar base, a delta after it, a compaction, and a delta after that."""
    e = customers(spark, sf_dir)
    e.execute("UPDATE cust SET balance = 0.5 WHERE k % 10 = 3")
    e.compact("cust")
    e.execute("DELETE FROM cust WHERE k % 20 = 3")
    return e.execute("SELECT * FROM cust")


@C.build(f"SELECT * FROM ({CUST}) WHERE k < 200")
def table_to_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A columnar table turned back to deltas."""
    e = customers(spark, sf_dir)
    e.to_rows("cust")
    e.execute("DELETE FROM cust WHERE k >= 200")
    return e.execute("SELECT * FROM cust")


@C.build(f"SELECT 'pinned' AS reader, * FROM ({CUST}) UNION ALL SELECT 'now', * FROM ({CUST}) WHERE k % 3 = 0")
def snapshot_through_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pinned reader keeps its rows through deletes, a compaction, a conversion to rows and back, and garbage collection."""
    e = customers(spark, sf_dir)
    reader = e.session()
    reader.execute("START TRANSACTION READ ONLY")
    e.execute("DELETE FROM cust WHERE k % 3 = 1")
    e.compact("cust")
    e.to_rows("cust")
    e.execute("DELETE FROM cust WHERE k % 3 = 2")
    e.compact("cust")
    e.collect_garbage()
    pinned = reader.execute("SELECT 'pinned' AS reader, * FROM cust")
    return pinned.unionByName(e.execute("SELECT 'now' AS reader, * FROM cust"))


@C.build(f"SELECT k, nation, CASE WHEN k % 2 = 0 THEN 7.5::DOUBLE ELSE balance END AS balance, segment FROM ({CUST}) WHERE k % 5 <> 0")
def reopen_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An engine that is opened on the path of another has its partitioned table, with layout and deltas."""
    e = customers(spark, sf_dir, BY_NATION)
    e.execute("UPDATE cust SET balance = 7.5 WHERE k % 2 = 0")
    e.compact("cust")
    e.execute("DELETE FROM cust WHERE k % 5 = 0")
    return Engine(spark, e.path).execute("SELECT * FROM cust")


BY_NATION = Partitioning("nation", [RangePart("low", 8), RangePart("mid", 16), RangePart("high", None)])
LISTED = Partitioning("nation", [ListPart("even", tuple(range(0, 26, 2))), ListPart("odd", tuple(range(1, 26, 2)))])


@C.build(f"SELECT nation, count(*) AS n FROM ({CUST}) WHERE nation >= 8 AND nation < 12 GROUP BY nation")
def partition_range_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir, BY_NATION).execute("SELECT nation, count(*) AS n FROM cust WHERE nation >= 8 AND nation < 12 GROUP BY nation")


@C.build(f"SELECT nation, count(*) AS n FROM ({CUST}) WHERE nation IN (2, 4) GROUP BY nation")
def partition_list_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir, LISTED).execute("SELECT nation, count(*) AS n FROM cust WHERE nation IN (2, 4) GROUP BY nation")


@C.build(f"SELECT * FROM ({CUST}) WHERE nation < 16")
def partition_alter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty a partition, drop it and add another."""
    e = customers(spark, sf_dir, BY_NATION)
    e.execute("DELETE FROM cust WHERE nation >= 16")
    e.execute("ALTER TABLE cust DROP PARTITION high")
    e.execute("ALTER TABLE cust ADD PARTITION (PARTITION top VALUES LESS THAN (100), PARTITION rest VALUES LESS THAN MAXVALUE)")
    return e.execute("SELECT * FROM cust")


@C.build(f"WITH c AS ({CUST}) SELECT 'balance' AS name, count(*) AS n_rows, CAST(count(*) - count(balance) AS BIGINT) AS nulls, CAST(min(balance) AS VARCHAR) AS lo, count(DISTINCT balance) AS n_distinct FROM c UNION ALL SELECT 'segment', count(*), CAST(count(*) - count(segment) AS BIGINT), min(segment), count(DISTINCT segment) FROM c")
def analyze_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = customers(spark, sf_dir)
    e.execute("ANALYZE TABLE cust")
    s = e.tables["cust"].stats
    text = lambda v: None if v is None else str(v)
    rows = [(c, s["row_count"], s["columns"][c]["null_count"], text(s["columns"][c]["min"]), s["columns"][c]["distinct"]) for c in ("balance", "segment")]
    return spark.createDataFrame(rows, "name string, n_rows long, nulls long, lo string, n_distinct long")


@C.build("SELECT * FROM (VALUES ('cust'), ('more')) t(table_name)")
def show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = customers(spark, sf_dir)
    e.execute("CREATE TABLE more (id INT PRIMARY KEY, amount DECIMAL(12,2) NOT NULL)")
    return e.execute("SHOW TABLES")


@C.build("""SELECT * FROM (VALUES ('id', 'int', 'NO', 'PRI', CAST(NULL AS VARCHAR), ''), ('amount', 'decimal(12,2)', 'NO', '', NULL, ''), ('note', 'string', 'YES', '', NULL, '')) t("Field", "Type", "Null", "Key", "Default", "Extra")""")
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    e.execute("CREATE TABLE more (id INT PRIMARY KEY, amount DECIMAL(12,2) NOT NULL, note VARCHAR(20))")
    return e.execute("DESCRIBE more")


@C.build()
def explain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).execute("EXPLAIN ANALYZE SELECT nation, count(*) AS n FROM cust WHERE balance > 0 GROUP BY nation")


TYPED = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType()), T.StructField("price", T.DecimalType(12, 2)), T.StructField("at", T.TimestampNTZType()), T.StructField("raw", T.BinaryType()), T.StructField("ok", T.BooleanType())])


def typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit('a "q", \\ '), F.col("o_orderpriority"))).alias("name"), F.col("o_totalprice").cast("decimal(12,2)").alias("price"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").cast("binary").alias("raw"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 2 == 0).alias("ok"))


ROUND_TRIP = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN 'a "q", \\ ' || o_orderpriority END AS name, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS price, o_orderdate AS at,
  hex(encode(o_orderstatus)) AS raw, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 2 = 0 END AS ok FROM orders"""


def plain(df: DataFrame) -> DataFrame:
    return df.withColumn("price", F.col("price").cast("double")).withColumn("raw", F.hex("raw"))


@C.build(ROUND_TRIP)
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{stage_root(spark)}/csv-{uuid.uuid4().hex}"
    files.write_csv(typed_rows(spark, sf_dir), path)
    return plain(files.read_csv(spark, path, TYPED))


@C.build(ROUND_TRIP)
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{stage_root(spark)}/jsonl-{uuid.uuid4().hex}"
    files.write_jsonl(typed_rows(spark, sf_dir), path)
    return plain(files.read_jsonl(spark, path, TYPED))


@C.build("SELECT o_orderkey FROM orders WHERE o_totalprice > 50000 AND o_orderstatus = 'F'")
def prepared_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    run_sql(spark, sf_dir, "SELECT 1 AS x FROM orders LIMIT 0")
    return Engine(spark).session().prepare("SELECT o_orderkey FROM orders WHERE o_totalprice > ? AND o_orderstatus = ?")(50000, "F")


@C.build("SELECT o_orderkey FROM orders WHERE o_totalprice > 70000")
def session_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    run_sql(spark, sf_dir, "SELECT 1 AS x FROM orders LIMIT 0")
    s = Engine(spark).session()
    return s.execute_batch("SET @low = 35000 * 2; SELECT o_orderkey FROM orders WHERE o_totalprice > @low")[-1]


@C.build("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t")
def recursive_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).execute("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t")


TREE = "WITH RECURSIVE t(k, depth) AS (SELECT o_orderkey, 0 FROM orders WHERE o_orderkey = 1 UNION ALL SELECT o.o_orderkey, t.depth + 1 FROM orders o JOIN t ON o.o_orderkey BETWEEN t.k * 2 AND t.k * 2 + 1 WHERE t.depth < 7 AND o.o_orderkey <> t.k) SELECT k, depth FROM t"


@C.build(TREE)
def recursive_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    run_sql(spark, sf_dir, "SELECT 1 AS x FROM orders LIMIT 0")
    return Engine(spark).execute(TREE)


REACH = "WITH RECURSIVE t(k) AS (SELECT n_nationkey FROM nation WHERE n_nationkey = 1 UNION SELECT b.n_nationkey FROM t JOIN nation a ON a.n_nationkey = t.k JOIN nation b ON b.n_regionkey = a.n_regionkey OR b.n_nationkey = a.n_nationkey + 6) SELECT k FROM t"


@C.build(REACH)
def recursive_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    run_sql(spark, sf_dir, "SELECT 1 AS x FROM nation LIMIT 0")
    return Engine(spark).execute(REACH)


@C.build(f"SELECT * FROM ({CUST}) WHERE k % 4 <> 1 UNION ALL SELECT k, nation, balance * 2, segment FROM ({CUST}) WHERE k % 4 = 1 AND k % 8 <> 1")
def merge_newest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest of many versions of a key, without an engine: base, puts and deletes."""
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("bigint").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    hot = base.where("k % 4 = 1")
    old = hot.withColumn("balance", F.lit(-1.0)).withColumns({tables.OP: F.lit("put"), tables.VERSION: F.lit(1).cast("long")})
    new = hot.withColumn("balance", F.col("balance") * 2).withColumns({tables.OP: F.when(F.col("k") % 8 == 1, "delete").otherwise("put"), tables.VERSION: F.lit(2).cast("long")})
    return tables.merge_on_read(base, old.unionByName(new), ["k"], ["k", "nation", "balance", "segment"])
