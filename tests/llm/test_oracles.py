"""The operators' queries against their SQL."""

import duckdb
import pytest

from spindle.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame, relation = QUERIES[name](spark, SF), con.sql(SQL[name])
    names = sorted(frame.columns)
    assert names == sorted(relation.columns)
    got = frame.select(*names).collect()
    want = relation.select(*names).fetchall()
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr(r) for r in want)
