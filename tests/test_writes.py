"""Definitions, constraints, writes, databases, restart and console."""

import io

import pytest
from pyspark.sql import functions as F

from spindle.cli import Console, saved_dir
from spindle.engine import Engine
from spindle.sources.script import split_statements


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "data"))
    good(e, "CREATE DATABASE d; USE d")
    return e


def good(e, script):
    for r in e.script(script):
        assert r.success, r.error


def bad(e, *statements):
    for s in statements:
        assert not e.execute(s).success, s


def rows(e, sql):
    r = e.execute(sql)
    assert r.success, r.error
    return r.rows()


def test_refused_definitions(engine):
    good(engine, "CREATE TABLE p (id INT PRIMARY KEY, a INT, s VARCHAR(5) UNIQUE, UNIQUE (a, s))")
    bad(
        engine, "CREATE TABLE p (id INT PRIMARY KEY)", "CREATE TABLE x (id INT)", "CREATE TABLE x (a INT PRIMARY KEY, a INT)", "CREATE TABLE x (a INT PRIMARY KEY, b INT PRIMARY KEY)", "CREATE TABLE x (a INT PRIMARY KEY, PRIMARY KEY (a))",
        "CREATE TABLE x (a INT, PRIMARY KEY (z))", "CREATE TABLE x (a INT PRIMARY KEY, UNIQUE (z))", "CREATE TABLE x (a INT PRIMARY KEY, CHECK (z > 1))", "CREATE TABLE x (a VARCHAR(0) PRIMARY KEY)",
        "CREATE TABLE x (a VARCHAR(3) PRIMARY KEY AUTO_INCREMENT)", "CREATE TABLE x (a INT PRIMARY KEY AUTO_INCREMENT DEFAULT 1)", "CREATE TABLE x (a INT PRIMARY KEY, f FLOAT DEFAULT 1)",
        "CREATE TABLE x (a INT PRIMARY KEY, b VARCHAR(2) DEFAULT 'abc')", "CREATE TABLE x (a INT PRIMARY KEY, CHECK (a > 1 OR a < 0))", "CREATE TABLE x (a INT PRIMARY KEY, CHECK (NOT a = 1))",
        "CREATE TABLE x (a INT PRIMARY KEY, CHECK (a IS NULL))", "CREATE TABLE x (a INT PRIMARY KEY, b INT, CHECK (a = b))", "CREATE TABLE x (a INT PRIMARY KEY, CHECK (x.a = 1))",
        "CREATE TABLE x (a INT PRIMARY KEY REFERENCES x(a))", "CREATE TABLE x (a INT PRIMARY KEY REFERENCES q(a))", "CREATE TABLE x (a INT PRIMARY KEY REFERENCES p(a))", "CREATE TABLE x (a FLOAT PRIMARY KEY REFERENCES p(id))",
        "CREATE TABLE x (a INT PRIMARY KEY, FOREIGN KEY (a) REFERENCES p(a, s))", "CREATE TABLE x (a INT PRIMARY KEY, s VARCHAR(5), FOREIGN KEY (s, a) REFERENCES p(s, a))",
        "CREATE INDEX i ON q (a)", "CREATE INDEX i ON p (z)", "DROP INDEX i", "DROP TABLE q", "DESCRIBE q", "DROP INDEX __unique_p_s",
    )
    good(engine, "CREATE TABLE c (id INT PRIMARY KEY, a INT, s VARCHAR(5), FOREIGN KEY (a, s) REFERENCES p(a, s)); CREATE INDEX i ON p (a)")
    bad(engine, "DROP TABLE p", "CREATE INDEX i ON c (a)")
    good(engine, "DROP TABLE c; DROP TABLE p; CREATE TABLE p (id INT PRIMARY KEY)")


def test_insert(engine):
    good(engine, "CREATE TABLE t (id INT PRIMARY KEY AUTO_INCREMENT, s VARCHAR(4) DEFAULT 'd' NOT NULL, f FLOAT, b BOOLEAN, CHECK (f > 0.5 AND f != 9.0))")
    good(engine, "INSERT INTO t VALUES (5, 'éa', 1.25, TRUE); INSERT INTO t (b, s) VALUES (FALSE, DEFAULT); INSERT INTO t (id) VALUES (DEFAULT)")
    bad(
        engine, "INSERT INTO t VALUES (1, 'a')", "INSERT INTO t (id, z) VALUES (1, 2)", "INSERT INTO t (id) VALUES (5)", "INSERT INTO t (id, s) VALUES (9, NULL)", "INSERT INTO t (id, s) VALUES (9, 'ééé')",
        "INSERT INTO t (id, f) VALUES (9, 1)", "INSERT INTO t (id, f) VALUES (9, 9.0)", "INSERT INTO t (id, f) VALUES (9, 0.5)", "INSERT INTO t (id) VALUES ('x')", "INSERT INTO q VALUES (1)", "INSERT INTO t (b) VALUES (1)",
    )
    assert rows(engine, "SELECT * FROM t") == [(5, "éa", 1.25, True), (6, "d", None, False), (7, "d", None, None)]
    good(engine, "DELETE FROM t WHERE id = 7; INSERT INTO t (f) VALUES (2.0)")
    assert rows(engine, "SELECT id, f FROM t WHERE id > 5") == [(6, None), (7, 2.0)]


def test_unique_and_null(engine):
    good(engine, "CREATE TABLE e (id INT PRIMARY KEY AUTO_INCREMENT, s INT, c INT, UNIQUE (s, c)); INSERT INTO e (s, c) VALUES (10, 100); INSERT INTO e (s, c) VALUES (10, NULL); INSERT INTO e (s, c) VALUES (10, NULL)")
    bad(engine, "INSERT INTO e (s, c) VALUES (10, 100)", "UPDATE e SET c = 100 WHERE id = 2", "UPDATE e SET c = 5")
    engine.checkpoint()
    bad(engine, "INSERT INTO e (s, c) VALUES (10, 100)", "CREATE UNIQUE INDEX u ON e (s)")
    good(engine, "INSERT INTO e (s, c) VALUES (10, 200); UPDATE e SET c = 100 WHERE id = 1; CREATE UNIQUE INDEX u ON e (c)")
    bad(engine, "INSERT INTO e (s, c) VALUES (11, 200)")
    good(engine, "DROP INDEX u; INSERT INTO e (s, c) VALUES (11, 200)")


def test_update(engine):
    good(engine, "CREATE TABLE t (id INT PRIMARY KEY, v INT DEFAULT 3 CHECK (v < 100), s VARCHAR(3) NOT NULL)")
    good(engine, "; ".join(f"INSERT INTO t VALUES ({k}, {k * 10}, 's{k}')" for k in range(1, 6)))
    engine.checkpoint()
    good(engine, "INSERT INTO t VALUES (6, NULL, 'x')")
    assert engine.execute("UPDATE t SET v = DEFAULT, s = 'new' WHERE id > 3 AND NOT v = 40").affected == 2
    bad(engine, "UPDATE t SET v = 100", "UPDATE t SET s = NULL", "UPDATE t SET s = 'long'", "UPDATE t SET v = 'x'", "UPDATE t SET z = 1", "UPDATE t SET id = 2 WHERE id = 1", "UPDATE t SET id = 9", "UPDATE t SET id = NULL WHERE id = 1")
    assert engine.execute("UPDATE t SET v = 'x' WHERE id = 77").affected == 0
    assert engine.execute("UPDATE t SET id = 9 WHERE v = 10").affected == 1
    assert rows(engine, "SELECT id, v, s FROM t") == [(2, 20, "s2"), (3, 30, "s3"), (4, 40, "s4"), (5, 3, "new"), (6, 3, "new"), (9, 10, "s1")]
    assert engine.execute("UPDATE t SET v = NULL WHERE EXISTS (SELECT 1 FROM t WHERE v = 40)").affected == 6


FAMILY = """CREATE TABLE a (id INT PRIMARY KEY, code VARCHAR(3) UNIQUE);
CREATE TABLE b (id INT PRIMARY KEY, a_id INT, FOREIGN KEY (a_id) REFERENCES a(id) ON DELETE CASCADE);
CREATE TABLE c (id INT PRIMARY KEY, b_id INT, code VARCHAR(3) REFERENCES a(code), FOREIGN KEY (b_id) REFERENCES b(id) ON DELETE CASCADE);
INSERT INTO a VALUES (1, 'x'); INSERT INTO a VALUES (2, 'y'); INSERT INTO a VALUES (3, NULL);
INSERT INTO b VALUES (10, 1); INSERT INTO b VALUES (11, 1); INSERT INTO b VALUES (12, 2); INSERT INTO b VALUES (13, NULL);
INSERT INTO c VALUES (100, 10, 'x'); INSERT INTO c VALUES (101, 12, NULL); INSERT INTO c VALUES (102, 12, 'y'); INSERT INTO c VALUES (103, NULL, 'y')"""


@pytest.mark.parametrize("checkpoint", [False, True])
def test_foreign_keys(engine, checkpoint):
    good(engine, FAMILY)
    if checkpoint:
        engine.checkpoint()
    bad(engine, "INSERT INTO b VALUES (14, 9)", "UPDATE b SET a_id = 9 WHERE id = 10", "UPDATE a SET id = 5 WHERE id = 1", "UPDATE a SET code = 'z' WHERE id = 2")
    good(engine, "UPDATE a SET code = 'y' WHERE id = 2; UPDATE a SET id = 4 WHERE id = 3; UPDATE b SET a_id = 4 WHERE id = 13")
    bad(engine, "DELETE FROM a WHERE id = 2")  # 103 keeps referring to its code
    assert engine.execute("DELETE FROM a WHERE id = 1").affected == 1  # 100 goes with it, and with it the only reference to 'x'
    assert rows(engine, "SELECT id FROM b") == [(12,), (13,)]
    assert rows(engine, "SELECT id FROM c") == [(101,), (102,), (103,)]
    good(engine, "DELETE FROM c; DELETE FROM a WHERE NOT id = 4")
    assert rows(engine, "SELECT id FROM a") == [(4,)] and rows(engine, "SELECT id, a_id FROM b") == [(13, 4)]


def test_rows_survive_a_restart(spark, tmp_path):
    first = Engine(spark, str(tmp_path))
    bad(first, "SELECT a FROM t", "SHOW TABLES", "INSERT INTO t VALUES (1)", "USE nope", "DROP DATABASE nope")
    good(first, "CREATE DATABASE d; CREATE DATABASE o; USE d; CREATE TABLE t (id INT PRIMARY KEY AUTO_INCREMENT, f FLOAT, b BOOLEAN, s VARCHAR(9)); INSERT INTO t (f, b, s) VALUES (0.1, TRUE, 'it''s;'); UPDATE t SET b = FALSE; INSERT INTO t (s) VALUES (NULL)")
    bad(first, "CREATE DATABASE d")
    second = Engine(spark, str(tmp_path))
    good(second, "USE d; USE d; INSERT INTO t (f) VALUES (1.0); DROP DATABASE o")
    assert [r[0] for r in second.execute("SHOW DATABASES").rows()] == ["d"]
    assert [(r[0], r[2], r[3]) for r in rows(second, "SELECT * FROM t")] == [(1, False, "it's;"), (2, None, None), (3, None, None)]
    good(second, "DROP DATABASE d")
    bad(second, "SHOW TABLES")


def test_many_inserts_become_parts(engine, monkeypatch):
    monkeypatch.setattr("spindle.sources.storage.LOG_ROWS", 4)
    monkeypatch.setattr("spindle.sources.storage.FAN", 2)
    good(engine, "CREATE TABLE t (id INT PRIMARY KEY)")
    good(engine, "; ".join(f"INSERT INTO t VALUES ({k})" for k in range(14)))
    bad(engine, "INSERT INTO t VALUES (1)")
    assert [r[0] for r in rows(engine, "SELECT id FROM t")] == list(range(14))
    assert len(engine.store.catalog.tables["t"].parts) <= 2


def test_two_writers(spark, tmp_path):
    """The one that has not seen the other's entry is refused, and no acknowledged row is lost."""
    one, two = Engine(spark, str(tmp_path)), Engine(spark, str(tmp_path))
    good(one, "CREATE DATABASE d; USE d; CREATE TABLE t (id INT PRIMARY KEY AUTO_INCREMENT, v INT)")
    good(two, "USE d; INSERT INTO t VALUES (1, 1)")
    bad(one, "INSERT INTO t VALUES (1, 2)")
    bad(one, "INSERT INTO t VALUES (1, 2)")  # now a repeated key
    good(one, "INSERT INTO t VALUES (2, 2)")
    one.checkpoint()
    bad(two, "INSERT INTO t (v) VALUES (3)")
    good(two, "INSERT INTO t (v) VALUES (3); UPDATE t SET v = 9 WHERE id = 1; INSERT INTO t (v) VALUES (4)")
    assert not one.insert_rows("t", spark.createDataFrame([(50, 5)], "id int, v int")).success
    bad(one, "INSERT INTO t VALUES (3, 2)")
    assert rows(one, "SELECT * FROM t") == rows(two, "SELECT * FROM t") == [(1, 9), (2, 2), (3, 3), (4, 4)]
    third = Engine(spark, str(tmp_path))
    good(third, "USE d")
    assert rows(third, "SELECT * FROM t") == [(1, 9), (2, 2), (3, 3), (4, 4)]
    assert not [n for n, _ in third.files.listed(f"{tmp_path}/d/journal") if n.endswith(".tmp")]
    names = [n for n, folder in third.files.listed(f"{tmp_path}/d/t") if folder]
    assert set(third.store.catalog.tables["t"].parts) <= set(names) and len(names) <= 3  # a refused load leaves no part


def test_levels(engine, spark, monkeypatch):
    """Many loads make few parts, and a large part is not rewritten for each of them."""
    monkeypatch.setattr("spindle.sources.storage.FAN", 3)
    good(engine, "CREATE TABLE t (id INT PRIMARY KEY)")
    written = []
    plain = engine.store.write_part
    monkeypatch.setattr(engine.store, "write_part", lambda table, frame, at=0, **more: written.append(at) or plain(table, frame, at, **more))
    for k in range(10):
        assert engine.insert_rows("t", spark.range(k * 10, k * 10 + 10).selectExpr("cast(id as int) AS id")).affected == 10
    assert sorted(written) == [0] * 10 + [1] * 3 + [2]
    assert [r[0] for r in rows(engine, "SELECT id FROM t")] == list(range(100))
    assert len(engine.store.catalog.tables["t"].parts) == 2


def test_files_hold_ranges_of_the_key(engine, spark):
    good(engine, "CREATE TABLE t (id INT PRIMARY KEY, s VARCHAR(50))")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert engine.insert_rows("t", spark.range(20_000).selectExpr("cast(hash(id) as int) AS id", "'x' AS s").dropDuplicates(["id"])).success
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    files = engine.store.frame(engine.store.catalog.tables["t"]).groupBy("_metadata.file_path").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    spans = sorted((r["low"], r["high"]) for r in files.collect())
    assert len(spans) > 1 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_bulk_rows_are_numbered(engine, spark):
    good(engine, "CREATE TABLE t (id INT PRIMARY KEY AUTO_INCREMENT, v INT CHECK (v < 1000)); INSERT INTO t VALUES (7, 0)")
    assert engine.insert_rows("t", spark.range(50).selectExpr("cast(id as int) AS v").repartition(6)).affected == 50
    assert sorted(r[0] for r in rows(engine, "SELECT id FROM t")) == list(range(7, 58))
    assert engine.insert_rows("t", spark.createDataFrame([(None, 1), (100, 2), (None, 3)], "id int, v int")).affected == 3
    assert [r[0] for r in rows(engine, "SELECT id FROM t WHERE id > 57")] == [100, 101, 102]
    good(engine, "INSERT INTO t (v) VALUES (5)")
    parts = list(engine.store.catalog.tables["t"].parts)
    for data, kind in [([(None, 1000)], "int"), ([(7, 1)], "int"), ([("x", 1)], "string")]:
        r = engine.insert_rows("t", spark.createDataFrame(data, f"id {kind}, v int"))
        assert not r.success and r.error
    assert rows(engine, "SELECT MAX(id), COUNT(*) FROM t") == [(103, 55)] and engine.store.catalog.tables["t"].parts == parts
    assert len([n for n, folder in engine.files.listed(f"{engine.store.folder}/t") if folder]) == len(parts)


def test_rows_checked_are_the_rows_written(engine, spark):
    good(engine, "CREATE TABLE t (id INT PRIMARY KEY, v INT)")
    shifting = spark.range(100).selectExpr("cast(id as int) AS id", "cast(rand() * 1000000 as int) AS v")
    assert engine.insert_rows("t", shifting).affected == 100
    assert rows(engine, "SELECT v FROM t") == rows(engine, "SELECT v FROM t") and len(rows(engine, "SELECT id FROM t")) == 100


def test_untouched_parts_are_kept(engine):
    good(engine, "CREATE TABLE t (id INT PRIMARY KEY, v INT); INSERT INTO t VALUES (1, 1)")
    engine.checkpoint()
    kept = list(engine.store.catalog.tables["t"].parts)
    good(engine, "INSERT INTO t VALUES (2, 2)")
    engine.checkpoint()
    good(engine, "UPDATE t SET v = 5 WHERE id = 2; DELETE FROM t WHERE v = 5")
    assert set(kept) <= set(engine.store.catalog.tables["t"].parts)
    assert rows(engine, "SELECT * FROM t") == [(1, 1)]


def test_bulk_insert(engine, spark):
    good(engine, FAMILY)
    assert engine.insert_rows("b", spark.createDataFrame([(20, 1), (21, None)], "id int, a_id int")).affected == 2
    for data in ([(20, 1)], [(30, 9)], [(31, 1), (31, 2)], [(None, 1)]):
        assert not engine.insert_rows("b", spark.createDataFrame(data, "id int, a_id int")).success
    assert not engine.insert_rows("a", spark.createDataFrame([(50, "long")], "id int, code string")).success
    assert len(rows(engine, "SELECT id FROM b")) == 6


def test_registered_files(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.register("nation", "/root/testdata/sf0.001/nation.parquet", ["n_nationkey"])
    assert len(rows(e, "SELECT n_name FROM nation WHERE n_regionkey = 1 LIMIT 3")) == 3
    good(e, "CREATE DATABASE d; USE d")
    bad(e, "DELETE FROM nation", "INSERT INTO nation VALUES (1, 'x', 1)")
    spark.range(5).selectExpr("cast(id as int) AS k", "id * 0.5 AS v").write.mode("overwrite").json(f"{tmp_path}/j")
    e.register("j", f"{tmp_path}/j", ["k"], format="json")
    assert rows(e, "SELECT COUNT(*), MAX(v) FROM j WHERE k > 1") == [(3, 2.0)]


def test_script_is_cut_at_semicolons():
    assert split_statements("a 'x;''y' -- z; w\n; b;;\n-- only a comment\n;c") == ["a 'x;''y' -- z; w", "b", "c"]


def test_a_script_file_runs(engine, tmp_path):
    (tmp_path / "s.sql").write_text("CREATE TABLE t (id INT PRIMARY KEY); -- one; two\nINSERT INTO t VALUES (1);\nINSERT INTO t VALUES (1);\nSELECT id FROM t")
    results = engine.run_script(str(tmp_path / "s.sql"))
    assert [r.success for r in results] == [True, True, False, True] and results[-1].rows() == [(1,)]


def test_console(spark, tmp_path):
    out, settings = io.StringIO(), tmp_path / "settings"
    console = Console(Engine(spark, str(tmp_path / "one")), out, settings)
    console.run("CREATE DATABASE d;\nUSE d;\nCREATE TABLE t\n (id INT PRIMARY KEY, s VARCHAR(5)); -- x\nINSERT INTO t VALUES (1, ';');\nSELECT * FROM t;\nSELEC;\n\\checkpoint\n\\path\nSELECT s FROM t".split("\n"))
    text = out.getvalue()
    assert "| id | s |\n+----+---+\n| 1  | ; |" in text and "1 row(s) in set" in text and "OK (1 row(s) affected)" in text
    assert "Error: expected a statement" in text and f"Data folder: {tmp_path / 'one'}" in text and "| ; |" in text
    console.run([f"\\path {tmp_path / 'two'}", "SHOW DATABASES;", "\\nope", "quit", "SELECT 1;"])
    assert saved_dir(settings) == str(tmp_path / "two") and "0 row(s) in set" in out.getvalue() and "unknown command" in out.getvalue()


def test_names_that_differ_in_case_are_two_columns(engine, spark):
    good(engine, "CREATE TABLE cc (id INT PRIMARY KEY AUTO_INCREMENT, a INT, A INT, Ab INT UNIQUE, aB VARCHAR(3), _path INT); CREATE TABLE kid (ID INT PRIMARY KEY, Ab INT, FOREIGN KEY (Ab) REFERENCES cc(Ab) ON DELETE CASCADE)")
    good(engine, "INSERT INTO cc (a, A, Ab, aB, _path) VALUES (1, 2, 3, 'x', 9); INSERT INTO cc (A, a, Ab) VALUES (5, 4, 6); INSERT INTO kid VALUES (1, 3); INSERT INTO kid VALUES (2, 6)")
    assert engine.insert_rows("cc", spark.createDataFrame([(7, 8, 9)], "a int, A int, Ab int")).success
    assert engine.execute("SELECT * FROM cc").headers == ["id", "a", "A", "Ab", "aB", "_path"]
    assert rows(engine, "SELECT a, A, Ab, aB, _path FROM cc") == [(1, 2, 3, "x", 9), (4, 5, 6, None, None), (7, 8, 9, None, None)]
    good(engine, "UPDATE cc SET A = 20 WHERE a = 4; DELETE FROM cc WHERE A = 2; UPDATE cc SET _path = 1 WHERE Ab = 9")
    assert rows(engine, "SELECT A, a, COUNT(*) FROM cc GROUP BY A, a ORDER BY A") == [(8, 7, 1), (20, 4, 1)]
    assert rows(engine, "SELECT kid.ID, cc.A FROM kid JOIN cc ON kid.Ab = cc.Ab") == [(2, 20)]
    bad(engine, "SELECT ab FROM cc", "SELECT AB FROM cc", "INSERT INTO cc (Ab) VALUES (6)", "CREATE TABLE d2 (id INT PRIMARY KEY, x INT, x INT)")
