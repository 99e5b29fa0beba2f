"""The operators that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from notegraph.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    columns = sorted(c[0] for c in found.description)
    want = [dict(zip([c[0] for c in found.description], r, strict=True)) for r in found.fetchall()]
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == columns
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(r[c] for c in columns) for r in want)
