"""Statements, transactions and their refusals."""

import gc
from datetime import datetime

import pytest

from quern.engine.normalize import SqlError, normalize, split_statements
from quern.engine.recursive import RecursionLimit, fixpoint
from quern.engine.session import ConflictError, Engine, PrivilegeError
from quern.sources.tables import ListPart, Partitioning, RangePart, TableError


def values(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    e.execute("CREATE TABLE r (id BIGINT PRIMARY KEY, grp VARCHAR(8), v INT, f DOUBLE)")
    e.execute("INSERT INTO r VALUES (1, 'a', 10, 1.5), (2, 'a', 20, NULL), (3, 'b', 30, 3.5), (4, NULL, NULL, 4.5)")
    return e


def test_normalize():
    assert normalize("SELECT a / b FROM t LIMIT 2, 3") == "SELECT a / nullif(b, 0) FROM t LIMIT 3 OFFSET 2"
    assert normalize("SELECT 'a / b' LIKE 'x\\y'") == "SELECT 'a / b' ILIKE 'x\\\\\\\\y'"
    assert normalize("SELECT d + INTERVAL '90' DAY (3)") == "SELECT d + INTERVAL '90' DAY"
    assert normalize('SELECT "it""s"') == "SELECT 'it\"s'"
    assert normalize("SELECT a DIV (b + 1) % -c") == "SELECT a DIV nullif((b + 1), 0) % nullif(- c, 0)"
    assert split_statements("SELECT ';'; SELECT 2;") == ["SELECT ';'", "SELECT 2"]
    with pytest.raises(SqlError):
        normalize("SELECT a / (b")


def test_division_and_like(engine):
    assert values(engine.execute("SELECT 7 / 0 AS a, 7 DIV 0 AS b, 7 % 0 AS c, -7 DIV 2 AS d, -7 % 2 AS e")) == [(None, None, None, -3, -1)]
    assert values(engine.execute("SELECT 'AbC' LIKE 'a_c' AS x, LENGTH('é') AS n")) == [(True, 2)]


def test_changes(engine):
    assert engine.execute("UPDATE r SET v = v + 1, f = v WHERE grp = 'a'").affected == 2
    assert values(engine.execute("SELECT id, v, f FROM r WHERE grp = 'a'")) == [(1, 11, 11.0), (2, 21, 21.0)]
    assert engine.execute("DELETE FROM r WHERE id = 9").affected == 0
    assert engine.execute("DELETE FROM r WHERE v IS NULL").affected == 1
    engine.execute("INSERT INTO r (id, v) VALUES (1, 5)")
    assert values(engine.execute("SELECT * FROM r WHERE id = 1")) == [(1, None, 5, None)]
    engine.compact("r")
    assert engine.execute("SELECT count(*) AS n FROM r").first()["n"] == 3
    engine.execute("TRUNCATE r")
    assert engine.execute("SELECT * FROM r").isEmpty()


@pytest.mark.parametrize("sql", ["INSERT INTO r VALUES (1, 'x', 1, 1.0), (1, 'y', 2, 2.0)", "INSERT INTO r (grp) VALUES ('x')", "UPDATE r SET id = 3", "INSERT INTO r (id, nope) VALUES (1, 2)", "SELECT * FROM r; SELECT 1", "CREATE FUNCTION f", "DROP TABLE nope", "CREATE TABLE r (id INT PRIMARY KEY)", "CREATE TABLE x (id DECIMAL(19,2) PRIMARY KEY)", "CREATE TABLE x (id INT)"])
def test_refused(engine, sql):
    with pytest.raises(Exception):
        out = engine.execute(sql)
        out.collect()


def test_snapshot_and_conflict(engine):
    a, b = engine.session(), engine.session()
    a.execute("BEGIN")
    b.execute("BEGIN")
    a.execute("UPDATE r SET v = 100 WHERE id = 1")
    assert b.execute("SELECT v FROM r WHERE id = 1").first()["v"] == 10
    b.execute("UPDATE r SET v = 200 WHERE id = 1")
    a.execute("COMMIT")
    with pytest.raises(ConflictError):
        b.execute("COMMIT")
    assert engine.execute("SELECT v FROM r WHERE id = 1").first()["v"] == 100


def test_write_skew_is_refused_when_serializable(spark):
    """Two accounts share a credit limit; each session sees room for its own payment only."""
    e = Engine(spark)
    e.execute("CREATE TABLE account (code VARCHAR(8) PRIMARY KEY, owed INT NOT NULL)")
    e.execute("INSERT INTO account VALUES ('home', 40), ('shop', 45)")
    sessions = {code: e.session() for code in ("home", "shop")}
    for code, s in sessions.items():
        s.execute("START TRANSACTION ISOLATION LEVEL SERIALIZABLE")
        assert s.execute("SELECT 100 - sum(owed) AS room FROM account").first()["room"] == 15
        s.execute(f"UPDATE account SET owed = owed + 15 WHERE code = '{code}'")
    sessions["shop"].execute("COMMIT")
    with pytest.raises(ConflictError):
        sessions["home"].execute("COMMIT")
    assert e.execute("SELECT sum(owed) AS n FROM account").first()["n"] == 100


def test_pinned_readers_keep_their_rows(engine):
    """Through compaction, conversion to rows, garbage collection; a session that is gone pins nothing."""
    reader = engine.session()
    reader.execute("START TRANSACTION READ ONLY")
    engine.compact("r")
    assert reader.execute("SELECT count(*) AS n FROM r").first()["n"] == 4
    engine.execute("DELETE FROM r WHERE id > 2")
    engine.to_rows("r")
    engine.compact("r")
    engine.collect_garbage()
    assert reader.execute("SELECT count(*) AS n FROM r").first()["n"] == 4
    assert engine.execute("SELECT count(*) AS n FROM r").first()["n"] == 2
    assert engine.table("r").state == "columns" and len(engine.table("r").layouts) == 2
    del reader
    gc.collect()
    assert engine.collect_garbage() >= 2 and len(engine.table("r").layouts) == 1 and not engine.table("r").deltas
    assert engine.execute("SELECT count(*) AS n FROM r").first()["n"] == 2


def test_conversion_conflicts_with_no_writer(engine):
    """A conversion is no change of rows: a transaction that was open meanwhile commits."""
    s = engine.session()
    s.execute("BEGIN")
    s.execute("UPDATE r SET v = 1 WHERE id = 1")
    engine.to_rows("r")
    engine.compact("r")
    s.execute("COMMIT")
    assert engine.execute("SELECT v FROM r WHERE id = 1").first()["v"] == 1


def test_reopened_engine(spark, engine):
    engine.execute("CREATE USER 'eve'")
    engine.execute("GRANT SELECT ON r TO 'eve'")
    engine.execute("CREATE TABLE p (d DATE, id INT, PRIMARY KEY (id, d)) PARTITION BY RANGE (d) (PARTITION a VALUES LESS THAN ('2020-01-01'), PARTITION b VALUES LESS THAN MAXVALUE)")
    engine.compact("r")
    engine.execute("UPDATE r SET v = 99 WHERE id = 3")
    again = Engine(spark, engine.path)
    assert values(again.execute("SELECT * FROM r")) == values(engine.execute("SELECT * FROM r"))
    assert again.version == engine.version and again.table("p").partitioning == engine.table("p").partitioning
    assert again.session("eve").execute("SELECT count(*) AS n FROM r").first()["n"] == 4
    again.execute("DROP TABLE r")
    assert "r" not in Engine(spark, engine.path).tables
    with pytest.raises(Exception, match="cannot be found"):
        Engine(spark, engine.path).execute("SELECT * FROM r")


def test_ticks_compact_tables_with_many_deltas(engine):
    for k in range(3):
        engine.execute(f"UPDATE r SET v = {k} WHERE id = 1")
    assert engine.tick(deltas=4) == ["r"] and engine.tick(deltas=4) == []
    assert engine.execute("SELECT v FROM r WHERE id = 1").first()["v"] == 2


def test_insert_select_reads_its_source_once(engine):
    """What is checked is what is written, though the source gives other rows each time it is run."""
    engine.execute("CREATE TABLE u (id VARCHAR(40) PRIMARY KEY)")
    done = engine.execute("INSERT INTO u SELECT uuid() AS id FROM r")
    assert done.affected == engine.execute("SELECT count(*) AS n FROM u").first()["n"] == 4


def test_typed_calls_in_text(engine):
    row = engine.execute("SELECT CONCAT(TRUE, 'x') AS a, SUBSTRING('abc', 0, 2) AS b, SUBSTRING('abcdef', -2) AS c, DATE('2024-01-31') + INTERVAL '1' MONTH AS d, CAST(TRUE AS CHAR) AS e, CAST(-2.5 AS SIGNED) AS f, CAST(' 7 ' AS SIGNED) AS g, CAST('on' AS BOOLEAN) AS h, CONCAT('a', NULL) AS i").first()
    assert tuple(row) == ("1x", "", "ef", datetime(2024, 2, 29), "1", -3, 7, None, None)
    assert values(engine.execute("SELECT CAST(v > 15 AS CHAR) AS k, count(*) AS n FROM r GROUP BY CAST(v > 15 AS CHAR)")) == [("0", 1), ("1", 2), (None, 1)]


def test_own_writes_and_rollback(engine):
    s = engine.session()
    s.execute("BEGIN")
    s.execute("DELETE FROM r WHERE id < 3")
    s.execute("INSERT INTO r (id) VALUES (1)")
    assert values(s.execute("SELECT id FROM r")) == [(1,), (3,), (4,)]
    s.execute("ROLLBACK")
    assert s.execute("SELECT count(*) AS n FROM r").first()["n"] == 4


def test_accounts(engine):
    engine.execute("CREATE USER 'ann'")
    ann = engine.session("ann")
    with pytest.raises(PrivilegeError):
        ann.execute("SELECT * FROM r")
    engine.execute("GRANT SELECT, INSERT ON r TO 'ann'")
    assert ann.execute("SELECT * FROM r").count() == 4
    engine.execute("REVOKE SELECT ON r FROM 'ann'")
    assert values(engine.execute("SHOW GRANTS FOR 'ann'")) == [("ann", "r", "INSERT")]


def test_partitions(spark):
    p = Partitioning("d", [RangePart("a", 10), RangePart("b", 20), RangePart("c", None)])
    assert p.pruned(low=12, high=15) == ["b"]
    assert p.pruned(equals=[3, 25]) == ["a", "c"]
    assert Partitioning("d", [ListPart("x", (1, 2)), ListPart("y", (3,))]).pruned(equals=[3]) == ["y"]
    for bad in ([RangePart("a", 5), RangePart("b", 5)], [RangePart("a", None), RangePart("b", 5)], [ListPart("a", (1,)), ListPart("b", (1,))]):
        with pytest.raises(TableError):
            Partitioning("d", bad)
    e = Engine(spark)
    e.execute("CREATE TABLE t (id INT, d INT, PRIMARY KEY (id, d)) PARTITION BY RANGE (d) (PARTITION a VALUES LESS THAN (10), PARTITION b VALUES LESS THAN (20))")
    e.execute("INSERT INTO t VALUES (1, 5), (2, 15)")
    with pytest.raises(TableError):
        e.execute("INSERT INTO t VALUES (3, 50)")
    with pytest.raises(TableError):
        e.execute("ALTER TABLE t DROP PARTITION b")
    e.execute("DELETE FROM t WHERE d > 9")
    e.execute("ALTER TABLE t REORGANIZE PARTITION b INTO (PARTITION b1 VALUES LESS THAN (15), PARTITION b2 VALUES LESS THAN MAXVALUE)")
    e.execute("INSERT INTO t VALUES (3, 50)")
    e.compact("t")
    assert values(e.execute("SELECT id FROM t WHERE d >= 15")) == [(3,)]


def test_recursion_limits(spark):
    with pytest.raises(RecursionLimit):
        fixpoint(spark.sql("SELECT 1 AS n"), lambda t: t.selectExpr("n + 1 AS n"), distinct=False, max_rounds=3)
    got = fixpoint(spark.sql("SELECT 1 AS n"), lambda t: t.selectExpr("(n * 2) % 7 AS n"), distinct=True)
    assert values(got) == [(1,), (2,), (4,)]


def test_explain(engine):
    plan = engine.execute("EXPLAIN SELECT grp, count(*) AS n FROM r GROUP BY grp").collect()
    assert plan[0]["parent_id"] is None and any("Aggregate" in r["operation"] for r in plan)


def test_statistics_have_no_switch(spark):
    """One more value than a former limit changes the counts by one, in base rows and deltas."""
    e = Engine(spark)
    e.register("big", spark.range(200_000).selectExpr("id AS k", "CAST(id AS STRING) AS s", "CAST(id % 3 AS INT) AS g"), ["k"])
    for n, add in [(200_000, None), (200_001, "(200000, 'one', NULL)"), (200_001, "(200000, '7', NULL)")]:
        if add:
            e.execute(f"INSERT INTO big VALUES {add}")
        assert e.execute("ANALYZE TABLE big").affected == n
        c = e.tables["big"].stats["columns"]
        assert [(c[x]["distinct"], c[x]["null_count"]) for x in "ksg"] == [(n, 0), (200_000 if add and "7" in add else n, 0), (3, int(n > 200_000))]
