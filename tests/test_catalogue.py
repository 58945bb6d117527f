"""Every query of the catalogue against its ANSI twin in DuckDB."""

import pytest

from quern.plans.catalogue import CATALOGUE
from tests.conftest import DATA


def rows(columns, data):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(repr(tuple(r[i] for i in at)) for r in data)


@pytest.mark.parametrize("name", sorted(CATALOGUE.queries))
def test_query(spark, duck, name):
    df = CATALOGUE.queries[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    if name not in CATALOGUE.sql:
        assert got
        return
    cursor = duck.execute(CATALOGUE.sql[name])
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_tables(spark):
    """Joins over whole tables against plain loops."""
    orders = [(r["o_orderkey"], r["o_custkey"], r["o_totalprice"]) for r in spark.read.parquet(f"{DATA}/orders.parquet").collect()]
    by: dict = {}
    for key, customer, price in orders:
        by.setdefault(customer, []).append((key, price))
    links = sorted((a, b) for own in by.values() for a, _ in own for b, _ in own if a < b)
    got = lambda name: sorted(map(tuple, CATALOGUE.queries[name](spark, DATA).collect()))
    assert got("join_self_whole") == links and len(links) > len(got("join_self"))
    assert got("not_exists_residual_whole") == sorted((k,) for own in by.values() for k, p in own if p == max(q for _, q in own))
    assert [k for k, _ in got("join_string_keys_whole")] == sorted(k for k, _, _ in orders)
    assert sum(n for _, n in got("join_null_keys_whole")) > sum(n for _, n in got("join_null_keys"))
    assert len(got("join_bigint_precision_whole")) > len(got("join_bigint_precision"))
    assert CATALOGUE.queries["join_full_whole"](spark, DATA).count() > CATALOGUE.queries["join_full"](spark, DATA).count()


@pytest.mark.parametrize("case", ["many", "nulls", "empty"])
def test_statistics_of_any_table(spark, tmp_path, case):
    """analyze_stats against its SQL: over 200,000 balances, no balance at all, no row."""
    import duckdb

    n = {"many": 300_000, "nulls": 3, "empty": 0}[case]
    balance = "CASE WHEN id % 7 > 0 THEN id / 100 - 999.99 END" if case == "many" else "CAST(NULL AS DOUBLE)"
    spark.range(n).selectExpr("id AS c_custkey", "CAST(id % 25 AS INT) AS c_nationkey", f"CAST({balance} AS DOUBLE) AS c_acctbal", "CONCAT('S', id % 5) AS c_mktsegment").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    got = CATALOGUE.queries["analyze_stats"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(CATALOGUE.sql["analyze_stats"]).fetchall())
