"""The registered queries that SQL can express, and that all of them are there."""

import duckdb
import pytest

from tallyspark.llm import queries

SF = "/root/testdata/sf0.001"


def test_one_query_an_operator():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLES[name])
    columns = sorted(df.columns)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in found.fetchall())
