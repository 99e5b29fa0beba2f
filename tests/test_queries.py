"""Every query against its DuckDB equivalent on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from notegraph.service_queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in found], key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cursor = duck.execute(ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())


def test_streaming_equals_batch(spark, sf):
    stream = QUERIES["streaming_windows"](spark, sf).collect()
    batch = QUERIES["events_window"](spark, sf).collect()
    assert {(r["start"], r["event_type"], r["n"]) for r in stream} == {(r["start"], r["event_type"], r["n"]) for r in batch}


def test_entry(spark):
    assert set(__spark_entry__.entry(spark).columns) == {"note_id", "score", "position", "n_chars", "tokens"}


def test_pushdown(spark, sf):
    plan = QUERIES["scope_isolation"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,src3)" in plan and "ReadSchema: struct<source:string>" in plan
