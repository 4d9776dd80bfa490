"""Queries against their SQL on the smallest tables."""

import duckdb
import pytest

from polyscene.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    theirs = con.execute(queries.ORACLES[name]).df()
    mine = queries.QUERIES[name](spark, DATA).toPandas()[list(theirs.columns)]
    assert sorted(map(tuple, mine.values.tolist())) == sorted(map(tuple, theirs.values.tolist()))
