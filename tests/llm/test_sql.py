"""Corpus queries that have an SQL counterpart, on given tables."""

import duckdb
import pytest

from plumbline.llm.oracle import LLM_ORACLE
from plumbline.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(LLM_ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(LLM_ORACLE[name])
    columns = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    rows = sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
    got = LLM_QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == rows
