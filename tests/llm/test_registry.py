"""The operators' columns that SQL can express, against DuckDB."""

import duckdb
import pytest

from sparrowmill.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_columns_match_sql(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.execute(ORACLES[name])
    columns = [d[0] for d in rel.description]
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    assert got == sorted(rel.fetchall(), key=str)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11))
