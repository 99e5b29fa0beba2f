"""The stored text index against scans, cascades along all keys, and files of notes."""

import re

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from notegraph.catalog import Scope
from notegraph.models import HashEmbedder
from notegraph.operators import lexical, mutations
from notegraph.plans import textindex
from notegraph.plans.memory import of_project
from notegraph.plans.search import Search, SearchOptions, SearchRequest
from notegraph.queries import TERMS
from notegraph.schemas import FOREIGN_KEYS, RELATIONS
from notegraph.sources import connectors
from tests.test_memory import put, said

NOTES = "note_id string, project_id string, content string, context string, tags array<string>"


def some_notes(spark):
    rows = [("a", "p", "red green red", "green", ["blue"]), ("b", "p", "green", "", None), ("c", "q", "red blue green", None, []), ("d", "q", None, "red", ["green", "red"]), ("e", None, "", None, None), ("f", "p", "red " * 300 + "green", "x", None)]
    return spark.createDataFrame(rows, NOTES)


def built(spark, root, notes, cut="note_id < 'c'"):
    for rows in (notes.filter(cut), notes.filter(f"not ({cut})")):
        assert textindex.add(spark, root, rows, 8)
    return textindex.TextIndex(spark, root, whole=True)


@pytest.mark.parametrize("asked", [["red"], ["red", "green"], ["green", "blue", "red"], ["nothing"], ["red", "nothing"], []])
def test_index_ranks_as_a_scan(spark, tmp_path, asked):
    notes = some_notes(spark)
    index = built(spark, str(tmp_path), notes)
    posts = index.postings(asked)
    got = lexical.top_k_indexed(posts, notes, asked, 4)
    assert [tuple(r) for r in got.collect()] == ([tuple(r) for r in lexical.top_k(notes, asked, 4).collect()] if asked else [])
    assert [tuple(r) for r in lexical.top_k_indexed(posts, notes, asked, 4, positions=True).collect()] == [tuple(r) for r in lexical.top_k_positions(notes, asked, 4).collect()]
    if asked:
        assert [tuple(r) for r in lexical.okapi_indexed(posts, index.counts(asked), index.totals(), asked, 4).collect()] == [tuple(r) for r in lexical.okapi(notes, asked, 4).collect()]


def test_index_reads_the_buckets_of_its_terms(spark, sf, tmp_path):
    notes = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("cast(doc_id as string) note_id", "source project_id", "text content")
    root = str(tmp_path)
    index = built(spark, root, notes, "note_id < '2'")
    files = index.postings(["the"]).inputFiles()
    assert {int(re.search("bucket=([0-9]+)", f)[1]) for f in files} == set(index._buckets(["the"])) and len(index._buckets(["the"])) == 1
    assert {re.search("batch=([0-9]+)", f)[1] for f in files} == {"1", "2"}
    plan = lexical.top_k_indexed(index.postings(["the"]), notes, ["the"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "text" not in plan.split("ReadSchema")[1]
    counts = {r["term"]: r["n"] for r in index.counts(TERMS).groupBy("term").agg(F.sum("notes").alias("n")).collect()}
    assert counts == {r["term"]: r["df"] for r in lexical.postings(notes.select("note_id", "content")).select("term", "note_id").distinct().filter(F.col("term").isin(TERMS)).groupBy("term").agg(F.count("*").alias("df")).collect()}


def test_ingested_notes_are_searched_by_the_index(spark, tmp_path):
    root = str(tmp_path)
    put(spark, root, [("a", "p", said(["red cars", "green cars"], [("Ann", "k")])), ("b", "q", said(["red houses"], [("Bob", "k")]))], buckets=4)
    put(spark, root, [("c", "p", said(["red red cars"], [("Ann", "k")]))], buckets=4)
    m = of_project(spark, root, Scope("o", "u", "p"))
    search = Search(spark, m, HashEmbedder(), options=SearchOptions(abstain=False))
    assert [r["note_id"] for r in search.streams(SearchRequest("red"))["lexical"].orderBy("rank").collect()] == ["c/0", "a/0"]
    assert m.index.postings(["houses"]).isEmpty() and m.index.totals().agg(F.sum("notes")).first()[0] == 3
    assert of_project(spark, root, None).index.postings(["red"]).isEmpty()


def test_cascades_along_all_keys(spark):
    """Of two projects with a row in every relation one goes; of the other an episode, which its note outlives."""
    rows = {n: [] for n in RELATIONS}
    for p in ("p", "q"):
        of = {"project_id": p, "organization_id": "o", "user_id": "u", "note_id": f"n{p}", "related_note_id": f"m{p}", "source_episode_id": f"e{p}", "entity_id": f"x{p}", "from_id": f"x{p}", "to_id": f"x{p}"}
        ids = {"organizations": "o", "users": "u", "projects": p, "episodes": f"e{p}", "notes": f"n{p}", "entities": f"x{p}"}
        for n, schema in RELATIONS.items():
            rows[n].append(tuple(ids.get(n, "i") if c == "id" else of.get(c) for c in schema.names))
        rows["notes"].append(tuple(f"m{p}" if c == "id" else of.get(c) for c in RELATIONS["notes"].names))
    nullable = lambda s: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in s.fields)
    tables = {n: spark.createDataFrame(r, nullable(RELATIONS[n])) for n, r in rows.items()}
    out = mutations.delete(tables, "projects", spark.createDataFrame([("p",)], "k string"), FOREIGN_KEYS)
    for n, df in out.relations.items():
        assert df.columns == tables[n].columns
        if "project_id" in df.columns:
            assert {r["project_id"] for r in df.collect()} == {"q"}, n
    for child, column, parent, _ in FOREIGN_KEYS:
        assert mutations.orphans(out.relations[child], out.relations[parent], column, "id").isEmpty(), (child, column)
    assert out.blocked.isEmpty() and {r["_k"] for r in out.gone["notes"].collect()} == {"np", "mp"}
    after = mutations.delete(out.relations, "episodes", spark.createDataFrame([("eq",), ("none",)], "k string"), FOREIGN_KEYS).relations
    assert after["episodes"].isEmpty() and {(r["id"], r["source_episode_id"]) for r in after["notes"].collect()} == {("nq", None), ("mq", None)}
    assert after["note_embeddings"].count() == 1
    stray = tables | {"notes": tables["notes"].limit(0)}
    assert {tuple(r) for r in mutations.delete(stray, "projects", spark.createDataFrame([("p",)], "k string"), [k for k in FOREIGN_KEYS if k[1] != "entity_id"]).blocked.collect()} >= {("note_embeddings", "project_id", 1), ("note_relations", "project_id", 1)}


def test_a_circle_of_keys_raises():
    with pytest.raises(ValueError):
        mutations.in_order([("a", "x", "b", "cascade"), ("b", "y", "a", "cascade")])


def test_notes_as_files(spark, tmp_path):
    """Each note is a file that comes back as its content; those whose names agree to the eighth character of their ids have files of their own, and a second export changes nothing."""
    rows = [(f"0000000{i}-1111", i % 3, c, "2024-01-02 03:04:05") for i, c in enumerate(["One note: é", "two\n\nlines", "", None, "x" * 100])] + [("same-id-11-a", 0, "same", "2024-01-02 03:04:05"), ("same-id-11-b", 0, "same", "2024-01-02 03:04:05")]
    notes = spark.createDataFrame(rows, "note_id string, kind int, content string, at string").select("note_id", "kind", "content", F.to_timestamp("at").alias("created_at"), F.array(F.lit("t")).alias("tags"), F.array().cast("array<string>").alias("keywords"), F.lit("a: b").alias("context"))
    for _ in range(2):
        connectors.export_markdown(notes.repartition(3), str(tmp_path / "out"))
        names = sorted(p.name for p in (tmp_path / "out").iterdir())
        assert len([n for n in names if n.endswith(".md")]) == 7 and (tmp_path / "out" / "_SUCCESS").read_text() == "7" and len(names) == 8
    back = connectors.markdown_episodes(connectors.markdown_files(spark, str(tmp_path / "out"))).collect()
    assert sorted(r["content"] for r in back if r["status"] == "ok") == sorted(c for _, _, c, _ in rows if c)
    assert all('context: "a: b"' in r["header"] for r in back)


def test_a_bad_name_leaves_no_mark(spark, tmp_path):
    spark.dataSource.register(connectors.TextFiles)
    bad = spark.createDataFrame([("../x.md", "t")], "file string, text string")
    with pytest.raises((PythonException, Exception), match="no file may be named"):
        bad.write.format("text_files").mode("append").option("path", str(tmp_path / "out")).save()
    assert not (tmp_path / "out" / "_SUCCESS").exists()


def test_index_without_a_shuffle(spark):
    """A note's postings come from its row alone, a long one's too, and are those of plain Python."""
    notes = some_notes(spark).unionByName(spark.createDataFrame([("g", "p", " ".join(f"w{i % 700}" for i in range(20_000)), "w1", ["w1"])], NOTES))
    rows = lexical.index(notes)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {(r["note_id"], r["term"]): r for r in rows.collect()}
    long = got["g", "w1"]
    at = [i + 1 for i in range(20_000) if i % 700 == 1] + [20_001, 20_002]
    assert long["times"] == len(at) - 2 and long["length"] == 20_000 and long["score"] == pytest.approx(len(at) - 2 + 0.5)
    assert [p["at"] for p in long["places"]] == sorted({min(x, 16_383) for x in at}) + [16_383] * 2
    assert [tuple(p) for p in got["a", "green"]["places"]] == [(2, 1.0), (4, 0.4)] and len(got) == 700 + 12
