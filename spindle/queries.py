"""Queries of the dialect over the test tables, each with the ANSI SQL it must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine

KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"],
    "orders": ["o_orderkey"], "events": ["event_id"], "documents": ["doc_id"], "labels": ["doc_id"], "benchmark": ["item_id"],
    "pages": ["page_id"], "conversations": ["conv_id", "turn"], "embeddings": ["vec_id"], "lineitem": [],
}


@dataclass
class Spec:
    """sql in the dialect; names of its columns; oracle in ANSI SQL; columns to round to four digits.

    script: statements to run first, in a new database. shown: small SELECTs whose
    headers, row order and cell texts are the result, in place of sql's rows.
    """

    sql: str
    names: str
    oracle: str
    rounded: str = ""
    script: str = ""
    shown: tuple[str, ...] = ()


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/spindle-engine-{uuid.uuid4().hex}"


def _tables(sql: str) -> list[str]:
    return [t for t in KEYS if f" {t}" in sql.replace("\n", " ")]


def run(spec: Spec) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, _folder(spark))
        for name in _tables(" ".join((spec.sql, *spec.shown))):
            engine.register(name, f"{sf_dir}/{name}.parquet", KEYS[name])
        if spec.script:
            for statement in ("CREATE DATABASE work", "USE work"):
                engine.execute(statement)
            results = engine.script(spec.script)
        if spec.shown:
            texts = []
            for k, sql in enumerate(spec.shown):
                result = engine.execute(sql)
                texts += [(k + 1, at + 1, "|".join(result.headers), "|".join(cells)) for at, cells in enumerate(result.text_rows())]
            return spark.createDataFrame(texts, "statement int, position int, header string, cells string")
        if spec.script:
            if spec.sql == "":
                rows = [(k + 1, r.success, r.affected) for k, r in enumerate(results)]
                return spark.createDataFrame(rows, "statement int, success boolean, affected int")
        if spec.sql.startswith(("DESCRIBE", "SHOW")):
            result = engine.execute(spec.sql)
            listed = [(k + 1, *row) for k, row in enumerate(result.listed)]
            return spark.createDataFrame(listed, "position int, " + ", ".join(f"{n} string" for n in spec.names.split()))
        out = engine.sql(spec.sql).toDF(*spec.names.split())
        return out.withColumns({c: F.round(c, 4) for c in spec.rounded.split()})

    return query


SHOP = """
CREATE TABLE customers (id INT PRIMARY KEY AUTO_INCREMENT, name VARCHAR(20) NOT NULL, city VARCHAR(20) DEFAULT 'Oslo');
CREATE TABLE orders_ (id INT PRIMARY KEY, customer_id INT, amount FLOAT CHECK (amount > 0), FOREIGN KEY (customer_id) REFERENCES customers(id) ON DELETE CASCADE);
CREATE TABLE lines (order_id INT, pos INT, item VARCHAR(10), PRIMARY KEY (order_id, pos), FOREIGN KEY (order_id) REFERENCES orders_(id) ON DELETE CASCADE);
INSERT INTO customers (name) VALUES ('Ann'); INSERT INTO customers (name, city) VALUES ('Bob', 'Rome');
INSERT INTO customers (name, city) VALUES ('Cleo', NULL); INSERT INTO customers VALUES (10, 'Dan', DEFAULT); INSERT INTO customers (name) VALUES ('Eve');
INSERT INTO orders_ VALUES (1, 1, 10.5); INSERT INTO orders_ VALUES (2, 1, 50.0); INSERT INTO orders_ VALUES (3, 2, 20.25); INSERT INTO orders_ VALUES (4, NULL, 5.0);
INSERT INTO lines VALUES (1, 1, 'nut'); INSERT INTO lines VALUES (1, 2, 'bolt'); INSERT INTO lines VALUES (3, 1, 'nut');
"""

PAIRS = """
CREATE TABLE l (id INT PRIMARY KEY, k INT, f FLOAT, s VARCHAR(10)); CREATE TABLE r (id INT PRIMARY KEY, k INT, f FLOAT);
INSERT INTO l VALUES (1, 1, 1.0, 'a_b'); INSERT INTO l VALUES (2, NULL, NULL, NULL); INSERT INTO l VALUES (3, 3, 2.5, 'a\\b'); INSERT INTO l VALUES (4, NULL, 4.0, 'axb');
INSERT INTO r VALUES (1, 1, 1.0); INSERT INTO r VALUES (2, NULL, 9.0); INSERT INTO r VALUES (3, 5, NULL);
"""

SPECS = {
    # predicates
    "filter_cmp": Spec("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_discount > 0.05 AND l_quantity >= 45", "l_orderkey l_linenumber l_quantity", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_discount > 0.05 AND l_quantity >= 45"),
    "filter_and_or": Spec("SELECT p_partkey, p_size FROM part WHERE p_size < 5 AND p_brand != 'Brand#11' OR p_size > 48 OR p_retailprice <= 905.0", "p_partkey p_size", "SELECT p_partkey, p_size FROM part WHERE p_size < 5 AND p_brand != 'Brand#11' OR p_size > 48 OR p_retailprice <= 905.0"),
    "filter_not": Spec("SELECT o_orderkey FROM orders WHERE NOT o_orderstatus = 'F' AND NOT o_totalprice < 100000", "o_orderkey", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice >= 100000"),
    "filter_like": Spec("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%' OR p_name LIKE '_l%'", "p_partkey p_name", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%' OR p_name LIKE '_l%'"),
    "filter_columns": Spec("SELECT c_custkey FROM customer WHERE c_custkey >= c_nationkey AND c_acctbal > c_custkey", "c_custkey", "SELECT c_custkey FROM customer WHERE c_custkey >= c_nationkey AND c_acctbal > c_custkey"),
    "filter_mixed_types": Spec("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber > 5.5 AND NOT l_returnflag = 7", "l_orderkey l_linenumber", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber > 5.5"),
    "filter_point": Spec("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 77", "o_orderkey o_custkey", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 77"),
    "filter_range": Spec("SELECT event_id, value FROM events WHERE event_type = 'click' AND value > 10 AND value <= 40.5", "event_id value", "SELECT event_id, value FROM events WHERE event_type = 'click' AND value > 10 AND value <= 40.5"),
    # select lists, order, limit
    "proj_star": Spec("SELECT * FROM nation", "n_nationkey n_name n_regionkey", "SELECT * FROM nation"),
    "proj_literal": Spec("SELECT 1, 'x', TRUE, r_name, NULL FROM region", "one x yes r_name nothing", "SELECT 1 AS one, 'x' AS x, true AS yes, r_name, NULL::VARCHAR AS nothing FROM region"),
    "order_limit": Spec("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC LIMIT 20", "c_custkey c_acctbal", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20"),
    "order_two_keys": Spec("SELECT s_suppkey, s_nationkey FROM supplier ORDER BY s_nationkey, s_suppkey DESC LIMIT 30", "s_suppkey s_nationkey", "SELECT s_suppkey, s_nationkey FROM supplier ORDER BY s_nationkey, s_suppkey DESC LIMIT 30"),
    "order_hidden": Spec("SELECT p_name FROM part ORDER BY p_partkey LIMIT 15", "p_name", "SELECT p_name FROM part ORDER BY p_partkey LIMIT 15"),
    "limit_by_key": Spec("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' LIMIT 7", "o_orderkey", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 7"),
    "limit_zero": Spec("SELECT r_name FROM region LIMIT 0", "r_name", "SELECT r_name FROM region LIMIT 0"),
    # joins
    "join_inner": Spec("SELECT o_orderkey, c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'", "o_orderkey c_name", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"),
    "join_left": Spec("SELECT o_orderkey, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey", "o_orderkey l_quantity", "SELECT o_orderkey, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey"),
    "join_right": Spec("SELECT quality, documents.doc_id FROM labels RIGHT JOIN documents ON labels.doc_id = documents.doc_id", "quality doc_id", "SELECT quality, d.doc_id FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id"),
    "join_self": Spec("SELECT a.n_name, b.n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey", "a b", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey"),
    "join_where_null": Spec("SELECT documents.doc_id, source FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id WHERE quality IS NULL", "doc_id source", "SELECT d.doc_id, source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NULL"),
    "join_chain3": Spec("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' OR c_acctbal < 0", "c_custkey n_name r_name", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' OR c_acctbal < 0"),
    "join_order_limit": Spec("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice DESC LIMIT 25", "o_orderkey c_name", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "join_null_safe": Spec("SELECT l.id, r.id FROM l JOIN r ON l.k = r.k", "a b", "SELECT * FROM (VALUES (1, 1), (2, 2), (4, 2)) AS t(a, b)", script=PAIRS),
    "join_unlike_types": Spec("SELECT l.id, r.id FROM l LEFT JOIN r ON l.k = r.f", "a b", "SELECT * FROM (VALUES (1, NULL), (2, 3), (3, NULL), (4, 3)) AS t(a, b)", script=PAIRS),
    # aggregates
    "agg_global": Spec("SELECT COUNT(*), MIN(l_quantity), MAX(l_shipdate), AVG(l_extendedprice), MEDIAN(l_extendedprice) FROM lineitem", "n low latest mean median", "SELECT count(*) AS n, min(l_quantity) AS low, max(l_shipdate) AS latest, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median FROM lineitem", "mean median"),
    "agg_empty": Spec("SELECT COUNT(*), COUNT(c_name), MAX(c_acctbal), AVG(c_acctbal) FROM customer WHERE c_custkey < 0", "n named top mean", "SELECT count(*) AS n, count(c_name) AS named, max(c_acctbal) AS top, avg(c_acctbal) AS mean FROM customer WHERE c_custkey < 0"),
    "agg_count_col": Spec("SELECT COUNT(*), COUNT(quality), MIN(source), MAX(toxic) FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id", "n labelled first toxic", "SELECT count(*) AS n, count(quality) AS labelled, min(source) AS first, max(toxic) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "group_by": Spec("SELECT l_returnflag, l_linestatus, COUNT(*), AVG(l_quantity), MEDIAN(l_discount), MAX(l_shipdate) FROM lineitem GROUP BY l_returnflag, l_linestatus", "flag status n mean median latest", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, round(avg(l_quantity), 4) AS mean, round(median(l_discount), 4) AS median, max(l_shipdate) AS latest FROM lineitem GROUP BY ALL", "mean median"),
    "group_having": Spec("SELECT l_returnflag, COUNT(*), AVG(l_quantity) FROM lineitem WHERE l_discount > 0.05 GROUP BY l_returnflag HAVING COUNT(*) > 10 AND NOT MAX(l_quantity) < 10 ORDER BY l_returnflag", "flag n mean", "SELECT l_returnflag AS flag, count(*) AS n, round(avg(l_quantity), 4) AS mean FROM lineitem WHERE l_discount > 0.05 GROUP BY 1 HAVING count(*) > 10", "mean"),
    "group_order_agg": Spec("SELECT o_custkey, COUNT(*) FROM orders GROUP BY o_custkey HAVING MAX(o_totalprice) > 1000 ORDER BY MIN(o_totalprice) DESC LIMIT 12", "o_custkey n", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING max(o_totalprice) > 1000 ORDER BY min(o_totalprice) DESC, 1 LIMIT 12"),
    "group_null_key": Spec("SELECT quality, COUNT(*), COUNT(quality) FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id GROUP BY quality", "quality n filled", "SELECT quality, count(*) AS n, count(quality) AS filled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1"),
    "group_distinct": Spec("SELECT event_type FROM events GROUP BY event_type", "event_type", "SELECT DISTINCT event_type FROM events"),
    "group_join": Spec("SELECT n_name, COUNT(*), AVG(c_acctbal) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name ORDER BY COUNT(*) DESC", "n_name n mean", "SELECT n_name, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1", "mean"),
    "having_first_row": Spec("SELECT c_nationkey, COUNT(*) FROM customer GROUP BY c_nationkey HAVING c_mktsegment = 'BUILDING'", "c_nationkey n", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING arg_min(c_mktsegment, c_custkey) = 'BUILDING'"),
    # subqueries
    "in_sub": Spec("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)", "c_custkey", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)"),
    "not_in_sub": Spec("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)", "o_orderkey", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"),
    "exists_corr": Spec("SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT * FROM lineitem WHERE l_suppkey = s.s_suppkey AND l_quantity > 49)", "s_suppkey", "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT * FROM lineitem WHERE l_suppkey = s.s_suppkey AND l_quantity > 49)"),
    "not_exists_corr": Spec("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = d.doc_id)", "doc_id", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"),
    "exists_or": Spec("SELECT c_custkey FROM customer c WHERE c_acctbal < -900 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_totalprice > 450000)", "c_custkey", "SELECT c_custkey FROM customer c WHERE c_acctbal < -900 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_totalprice > 450000)"),
    "exists_theta": Spec("SELECT r_name FROM region r WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey < r.r_regionkey AND n_nationkey > 20)", "r_name", "SELECT r_name FROM region r WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey < r.r_regionkey AND n_nationkey > 20)"),
    "exists_ignores_list": Spec("SELECT r_name FROM region r WHERE EXISTS (SELECT COUNT(*) FROM nation WHERE n_regionkey = r.r_regionkey AND n_name LIKE 'A%')", "r_name", "SELECT r_name FROM region r WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r.r_regionkey AND n_name LIKE 'A%')"),
    "in_limit": Spec("SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region LIMIT 2)", "n_name", "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region ORDER BY r_regionkey LIMIT 2)"),
    "in_join": Spec("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND o_totalprice > 300000", "o_orderkey", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND o_totalprice > 300000"),
    "not_in_null": Spec("SELECT id FROM l WHERE id NOT IN (SELECT k FROM r)", "id", "SELECT 0 AS id WHERE false", script=PAIRS),
    "not_null_2vl": Spec("SELECT id FROM l WHERE NOT k = 1", "id", "SELECT * FROM (VALUES (2), (3), (4)) AS t(id)", script=PAIRS),
    "not_in_2vl": Spec("SELECT id FROM l WHERE NOT k IN (SELECT k FROM r)", "id", "SELECT * FROM (VALUES (2), (3), (4)) AS t(id)", script=PAIRS),
    "like_plain_backslash": Spec("SELECT id FROM l WHERE s LIKE 'a\\b'", "id", "SELECT 3 AS id", script=PAIRS),
    # headers, row order, texts, refusals
    "left_wins": Spec("SELECT id, r.id FROM l JOIN r ON l.k = r.k", "a b", "SELECT * FROM (VALUES (1, 1), (2, 2), (4, 2)) AS t(a, b)", script=PAIRS),
    "shown_groups": Spec(
        "", "", "SELECT 1::INT AS statement, (row_number() OVER (ORDER BY r_name))::INT AS position, 'r_name|COUNT(*)|AVG(n_nationkey)' AS header, r_name || '|' || count(*) || '|' || printf('%.6f', avg(n_nationkey)) AS cells FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
        shown=("SELECT r_name, COUNT(*), AVG(n_nationkey) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",),
    ),
    "shown_texts": Spec(
        "", "", "SELECT * FROM (VALUES (1::INT, 1::INT, '1|x|NULL|id', '1|x|NULL|1'), (2, 1, 'COUNT(*)|MAX(f)|COUNT(k)', '3|9.000000|2'), (3, 1, 'id|f|s', '2|NULL|NULL'), (3, 2, 'id|f|s', '3|2.500000|a\\b'), (3, 3, 'id|f|s', '4|4.000000|axb'), (4, 1, 'id|id', '1|1'), (4, 2, 'id|id', '2|2'), (4, 3, 'id|id', '4|2'), (5, 1, 'k|COUNT(*)', 'NULL|2'), (5, 2, 'k|COUNT(*)', '1|1'), (5, 3, 'k|COUNT(*)', '3|1'), (6, 1, 'k', '1'), (6, 2, 'k', '3'), (6, 3, 'k', 'NULL'), (6, 4, 'k', 'NULL')) AS t(statement, position, header, cells)",
        script=PAIRS,
        shown=("SELECT 1, 'x', NULL, id FROM l WHERE id = 1", "SELECT COUNT(*), MAX(f), COUNT(k) FROM r ORDER BY id LIMIT 0", "SELECT id, f, s FROM l WHERE id > 1", "SELECT l.id, r.id FROM l JOIN r ON l.k = r.k", "SELECT k, COUNT(*) FROM l GROUP BY k", "SELECT k FROM l ORDER BY k"),
    ),
    "refused_statements": Spec(
        "", "", "SELECT k::INT AS statement, k <= 11 OR k IN (24, 26, 29) AS success, (CASE WHEN k BETWEEN 3 AND 9 OR k IN (11, 29) THEN 1 ELSE 0 END)::INT AS affected FROM range(1, 30) AS t(k)",
        script=PAIRS + """CREATE TABLE n (id INT PRIMARY KEY, v INT NOT NULL, s VARCHAR(2)); INSERT INTO n VALUES (1, 1, 'ab');
        SELECT s FROM l JOIN r ON l.k = r.k WHERE id = 1; SELECT id, COUNT(*) FROM l; SELECT id FROM l HAVING COUNT(*) > 1; SELECT id FROM l ORDER BY COUNT(*); SELECT k FROM l GROUP BY k ORDER BY f; SELECT k FROM l GROUP BY f;
        SELECT AVG(s) FROM l; SELECT MEDIAN(s) FROM l; SELECT id FROM l WHERE id IN (SELECT id, k FROM r); SELECT id FROM l WHERE id IN (SELECT * FROM r);
        SELECT id FROM l WHERE EXISTS (SELECT 1 FROM r WHERE EXISTS (SELECT 1 FROM n WHERE n.id = l.id)); SELECT l.id FROM l JOIN r ON l.id = s;
        CREATE UNIQUE INDEX i ON n (v); INSERT INTO n VALUES (2, 1, 'x'); DROP INDEX i; INSERT INTO n VALUES (2, NULL, 'x'); INSERT INTO n VALUES (2, 1, 'abc'); INSERT INTO n VALUES (2, 1, 'x')""",
    ),
    # definitions and writes
    "ddl_dml_roundtrip": Spec("SELECT id, name, city FROM customers", "id name city", "SELECT * FROM (VALUES (1, 'Ann', 'Oslo'), (2, 'Bob', 'Rome'), (3, 'Cleo', NULL), (10, 'Dan', 'Oslo'), (11, 'Eve', 'Oslo')) AS t(id, name, city)", script=SHOP),
    "update_rows": Spec("SELECT id, customer_id, amount FROM orders_", "id customer_id amount", "SELECT id, customer_id, amount::FLOAT AS amount FROM (VALUES (1, 2, 7.5), (2, 2, 7.5), (3, 2, 20.25), (4, NULL, 5.0)) AS t(id, customer_id, amount)", script=SHOP + "UPDATE orders_ SET customer_id = 2, amount = 7.5 WHERE customer_id = 1; UPDATE orders_ SET customer_id = 77 WHERE id = 4; UPDATE orders_ SET amount = -1.0;"),
    "update_key": Spec("SELECT id, name FROM customers", "id name", "SELECT * FROM (VALUES (1, 'Ann'), (2, 'Bob'), (3, 'Cleo'), (12, 'Dan'), (11, 'Eve')) AS t(id, name)", script=SHOP + "UPDATE customers SET id = 12 WHERE id = 10; UPDATE customers SET id = 11 WHERE id = 3; UPDATE customers SET id = 5 WHERE id = 1;"),
    "cascade_delete": Spec("SELECT order_id, pos, item FROM lines", "order_id pos item", "SELECT 3 AS order_id, 1 AS pos, 'nut' AS item", script=SHOP + "DELETE FROM customers WHERE name = 'Ann';"),
    "delete_where_in": Spec("SELECT id FROM orders_", "id", "SELECT * FROM (VALUES (3), (4)) AS t(id)", script=SHOP + "DELETE FROM orders_ WHERE customer_id IN (SELECT id FROM customers WHERE city = 'Oslo');"),
    "check_unique_fk": Spec(
        "", "", "SELECT statement::INT AS statement, success, affected::INT AS affected FROM (VALUES (1, true, 0), (2, true, 0), (3, true, 1), (4, false, 0), (5, false, 0), (6, true, 1), (7, true, 1), (8, false, 0), (9, true, 1), (10, false, 0), (11, false, 0), (12, true, 0)) AS t(statement, success, affected)",
        script="""CREATE TABLE u (id INT PRIMARY KEY, email VARCHAR(8) UNIQUE, age INT CHECK (age > 0 AND age < 150));
        CREATE TABLE p (id INT PRIMARY KEY, mail VARCHAR(8) REFERENCES u(email));
        INSERT INTO u VALUES (1, 'a@x', 30); INSERT INTO u VALUES (2, 'a@x', 30); INSERT INTO u VALUES (2, 'b@x', 150); INSERT INTO u VALUES (2, NULL, NULL); INSERT INTO u VALUES (3, NULL, 5);
        INSERT INTO p VALUES (1, 'no'); INSERT INTO p VALUES (1, 'a@x'); DELETE FROM u WHERE id = 1; DROP TABLE u; CREATE UNIQUE INDEX i ON u (age)""",
    ),
    "describe": Spec("DESCRIBE c", "field type nullable key def extra", "SELECT * FROM (VALUES (1::INT, 'id', 'INT', 'NO', 'PRI', 'NULL', 'AUTO_INCREMENT'), (2, 'mail', 'VARCHAR(9)', 'YES', 'UNI', 'NULL', ''), (3, 'age', 'INT', 'NO', 'MUL', '7', ''), (4, 'Create Table', 'CREATE TABLE c (id INT PRIMARY KEY AUTO_INCREMENT, mail VARCHAR(9) UNIQUE, age INT DEFAULT 7 NOT NULL);' || chr(10) || 'CREATE INDEX by_age ON c (age, mail)', '', '', '', '')) AS t(position, field, type, nullable, key, def, extra)", script="CREATE TABLE c (id INT PRIMARY KEY AUTO_INCREMENT, mail VARCHAR(9) UNIQUE, age INT DEFAULT 7 NOT NULL); CREATE INDEX by_age ON c (age, mail);"),
    "show_tables": Spec("SHOW TABLES", "name", "SELECT * FROM (VALUES (1::INT, 'a'), (2, 'b')) AS t(position, name)", script="CREATE TABLE b (id INT PRIMARY KEY); CREATE TABLE a (id INT PRIMARY KEY); CREATE TABLE c (id INT PRIMARY KEY); DROP TABLE c;"),
    "show_databases": Spec("SHOW DATABASES", "name", "SELECT * FROM (VALUES (1::INT, 'other'), (2, 'work')) AS t(position, name)", script="CREATE DATABASE other; CREATE DATABASE gone; DROP DATABASE gone;"),
}

QUERIES = {name: run(spec) for name, spec in SPECS.items()}
SQL = {name: spec.oracle for name, spec in SPECS.items()}
FLAGSHIP = "group_having"
