"""Every query of the entry module against its oracle SQL, at the smallest size."""

import duckdb
import pytest

from spindle.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr([r[k] for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    frame = QUERIES[name](spark, SF)
    relation = oracle.sql(SQL[name])
    assert sorted(frame.columns) == sorted(relation.columns)
    assert canonical(frame.collect(), frame.columns) == canonical(relation.fetchall(), relation.columns)
