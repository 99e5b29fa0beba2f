"""Writes, views, keys and reranking on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from notegraph import adapters as a
from notegraph import queries, storage
from notegraph.models import FirstLines, OverlapScorer
from notegraph.operators import accounts, fusion, memory
from notegraph.plans import views
from notegraph.plans.search import Memory, Search, SearchOptions, SearchRequest
from notegraph.sources import backups

ROWS = "id long, text string"


def test_commit(spark, tmp_path):
    root, schema = str(tmp_path), spark.createDataFrame([], ROWS).schema
    read = lambda name="t", **k: sorted(r["id"] for r in storage.committed(spark, root, name, schema, **k).collect())
    df = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], ROWS)
    assert read() == []
    df(9).write.parquet(f"{root}/t/batch=2")  # a try that failed before its commit
    assert read() == []
    assert storage.commit(spark, root, {"t": df(1, 2), "u": df(3)}, 1)
    assert read() == [1, 2] and read("u") == [3]
    assert not storage.commit(spark, root, {"t": df(5), "u": df(5)}, 1) and read() == [1, 2]
    assert storage.commit(spark, root, {"t": df(4)}, 2)
    assert read() == [1, 2, 4] and read(last=True) == [4] and read("u") == [3]


def test_half_staged(spark, tmp_path):
    """A batch whose second relation fails shows nothing of its first."""
    root, good = str(tmp_path), spark.createDataFrame([(1, "x")], ROWS)
    bad = good.withColumn("text", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        storage.commit(spark, root, {"t": good, "u": bad}, 1)
    assert storage.committed(spark, root, "t", good.schema).isEmpty()
    assert storage.commit(spark, root, {"t": good, "u": good}, 1)
    assert storage.committed(spark, root, "u", good.schema).count() == 1


def test_note_view(spark):
    note = "11111111-2222-3333-4444-555555555555"
    notes = spark.createDataFrame([(note, 'a "b"\nc', None, ["k"], [])], "note_id string, content string, context string, keywords array<string>, tags array<string>").withColumn("created_at", F.to_timestamp(F.lit("2024-01-02 03:04:05")))
    see = lambda i: json.loads(views.note_view(notes, i).first()["json"])
    assert see(note) == {"id": note, "content": 'a "b"\nc', "contextDescription": None, "keywords": ["k"], "tags": [], "createdAt": "2024-01-02T03:04:05", "supersededAt": None, "sourceEpisodeId": None}
    assert see(note.replace("1", "9")) is None and see("x") == {"error": "invalid uuid"}


def test_tokens(spark):
    made = accounts.new_token()
    assert made.startswith("memk_") and len(made) == 48 and made != accounts.new_token()
    got = spark.range(1).select(accounts.token(F.unhex(F.lit("fb" * 32))).alias("t")).first()["t"]
    assert len(got) == 48 and not set(got) & set("+/= ")
    with pytest.raises(ValueError, match="tenant schema"):
        accounts.create_database(spark, "default", drop=True)


def test_database(spark):
    name = "org_0123456789ab"
    accounts.create_database(spark, name)
    accounts.create_database(spark, name)
    assert spark.catalog.databaseExists(name)
    accounts.create_database(spark, name, drop=True)
    assert not spark.catalog.databaseExists(name)


def test_forced_drop(spark):
    rows = spark.createDataFrame([("a", "org_a", 1), ("b", "org_b", 0)], "organization_id string, schema_name string, status short")
    ids = spark.createDataFrame([("a",), ("b",), ("z",)], "id string")
    left, refused = accounts.drop_schemas(rows, ids)
    assert [r["organization_id"] for r in left.collect()] == ["a"] == [r["organization_id"] for r in refused.collect()]
    left, refused = accounts.drop_schemas(rows, ids, force=True)
    assert left.isEmpty() and refused.isEmpty()


def _hits(spark, n=3):
    return spark.createDataFrame([(i, 1.0 / (i + 1), i + 1) for i in range(n)], "note_id long, score double, position int")


def test_repeated_scores(spark):
    scores = spark.createDataFrame([(0, 0.1), (2, 0.9), (2, 0.8)], "note_id long, rerank double")
    got = fusion.rerank(_hits(spark), scores).orderBy("position").collect()
    assert [(r["note_id"], r["rerank"]) for r in got] == [(0, None), (1, None), (2, None)]
    got = fusion.rerank(_hits(spark), scores.filter("rerank <> 0.8")).orderBy("position").collect()
    assert [(r["note_id"], r["score"]) for r in got] == [(2, 0.9), (0, 0.1)]


class _Broken:
    def scores(self, query, texts):
        raise RuntimeError("down")


class _Seen:
    def scores(self, query, texts):
        self.texts = texts
        return [float(i) for i in range(len(texts))]


def _search(spark, sf, scorer, **more):
    m = Memory(a.notes(spark, sf), a.note_embeddings(spark, sf), mentions=a.mentions(spark, sf))
    options = SearchOptions(now=queries.NOW, rerank=True, abstain=False, **more)
    return Search(spark, m, queries._Fixed(queries._vector_of(spark, sf)), scorer=scorer, options=options)


def test_scorer(spark, sf):
    r = SearchRequest("the and of", max_results=50)
    seen = _Seen()
    plain = [x["note_id"] for x in _search(spark, sf, _Broken()).run(r).hits.orderBy("position").collect()]
    done = _search(spark, sf, seen).run(r).hits.orderBy("position").collect()
    n = len(seen.texts)
    assert n == min(20, len(plain)) and all(len(t) <= 601 for t in seen.texts)
    assert [x["note_id"] for x in done] == plain[1:n][::-1]  # the first got 0, so it drops
    assert all(x["related"] == sorted({f"s:{x['note_id'] % 100}", f"p:{x['note_id'] % 1000}"}) for x in done)
    assert OverlapScorer().scores("a b", ["A c", "b a"]) == [0.5, 1.0]


def test_blank_query(spark, sf):
    found = _search(spark, sf, None).run(SearchRequest(" \n"))
    assert found.hits.count() == 0 and found.decision is None and found.streams == {}


def test_graph_ignores_filters_unless_told(spark, sf):
    m = Memory(a.notes(spark, sf), a.note_embeddings(spark, sf), a.entities(spark, sf), a.edges(spark, sf), a.mentions(spark, sf))
    request = SearchRequest("nation_3 europe", tags=["no such tag"])
    found = [Search(spark, m, queries._Fixed(queries._vector_of(spark, sf)), options=SearchOptions(now=queries.NOW, graph_respects_filters=x)).streams(request)["graph"].count() for x in (False, True)]
    assert found[0] > 0 and found[1] == 0


def test_reflection_without_notes(spark, sf):
    notes, old = a.notes(spark, sf), a.reflections(spark, sf)
    row, message, n = memory.reflect(notes, old, "recent", "1990-01-01 00:00:00", FirstLines())
    assert row.isEmpty() and n == 0 and message.startswith("No notes found")
    row, message, n = memory.reflect(notes, old, "META:x", "1990-01-01 00:00:00", FirstLines())
    assert row.isEmpty() and message.startswith("No reflections found")


def test_bullet_without_context(spark):
    notes = spark.createDataFrame([("a", "x", None), ("b", "y", " "), ("c", "z", "ctx")], "note_id string, content string, context string").withColumn("created_at", F.to_timestamp(F.lit("2024-01-02 00:00:00")))
    assert memory.reflection_body(notes).first()["body"] == "- [2024-01-02] (ctx) z\n- [2024-01-02] y\n- [2024-01-02] x"


def test_plan_of_new_links(spark, sf):
    """Blocks of a small batch of sources: what moves grows with the rows alone."""
    from notegraph.operators import vector

    rows = a.note_embeddings(spark, sf)
    some = rows.filter("note_id % 50 = 3")
    want = {(r["source_id"], r["target_id"]) for r in vector.knn(rows, 4, block=64).filter("source_id % 50 = 3").collect()}
    assert {(r["source_id"], r["target_id"]) for r in vector.knn(rows, 4, sources=some, block=64).collect()} == want and want


def test_judge(spark):
    notes = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None), (5, None)], "note_id long, content string")
    pairs = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.7), (3, 1, 0.4), (4, 5, 0.9)], "source_id long, target_id long, similarity double")
    judged = memory.judge(pairs, notes)
    got = {(r["source_id"], r["target_id"]): (r["relation_type"], r["confidence"]) for r in judged.collect()}
    assert got == {(1, 2): ("duplicates", 1.0), (1, 3): ("related-to", 0.7), (3, 1): ("related-to", 0.4), (4, 5): ("related-to", 0.9)}
    kept = memory.judged_links(pairs, judged, pairs.filter("source_id = 4"))
    assert {(r["source_id"], r["target_id"]) for r in kept.collect()} == {(1, 2), (1, 3)}


def test_ppr_by_hand(spark):
    """Parallel edges, a self-loop, a node out of reach, and a seed without edges."""
    from notegraph.operators import graph

    pairs = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "c"), ("x", "y")]
    seeds = ["a", "lone"]
    ways = pairs + [(t, f) for f, t in pairs]
    out = {n: [t for f, t in ways if f == n] for n in {n for p in ways for n in p}}
    p = dict.fromkeys(seeds, 0.5)
    for _ in range(8):
        q = {n: 0.15 * 0.5 for n in seeds}
        for n, m in p.items():
            for t in out.get(n) or [n]:
                q[t] = q.get(t, 0) + 0.85 * m / len(out.get(n) or [n])
        p = q
    got = {r["entity_id"]: r["mass"] for r in graph.ppr(spark.createDataFrame(pairs, "from_id string, to_id string"), spark.createDataFrame([(n,) for n in seeds], "entity_id string")).collect()}
    assert got == pytest.approx(p) and "x" not in got
    none = spark.createDataFrame([], "from_id string, to_id string")
    assert graph.ppr(none, spark.createDataFrame([("a",)], "entity_id string")).collect()[0]["mass"] == 1.0


def test_extractions_are_made_once(spark, sf):
    """Rows that are rejected and rows that are not come from one pass over the texts."""
    from notegraph import service_queries

    plan = service_queries.QUERIES["extract_default"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and plan.count("from_json(") == 1


def test_edges_are_sorted_once_for_a_merge(spark, sf):
    from notegraph import queries

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = queries.QUERIES["edge_merge"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    merged = plan.split("SortMergeJoin")[0]
    assert merged.count("Sort [project_id") == 1


def test_copies_beyond_the_nearest_are_linked(spark):
    """A new note's earlier copy counts though other new copies of lesser id are as near, and without any vector."""
    from notegraph.plans import memory as plans

    rows = [("9", "p", "same"), ("1", "p", "same"), ("2", "p", "same"), ("3", "q", "same"), ("4", "p", "alone"), ("5", "p", None), ("6", "p", None)]
    notes = spark.createDataFrame([(*r, None) for r in rows], "note_id string, project_id string, content string, superseded_at timestamp")
    new = notes.filter("note_id <> '9'").select("note_id", "project_id")
    assert sorted(map(tuple, plans._copies(notes, new).collect())) == [("1", "9", 1.0), ("2", "9", 1.0)]


def test_backup_is_gzipped(spark, tmp_path):
    """A backup's files are compressed, and hold every row in order of time."""
    rows = spark.createDataFrame([(str(i), f"text {i} " * 50, f"2024-01-{i + 1:02d}") for i in range(20)], "id string, content string, ingested_at string")
    tally = backups._written(rows.orderBy("ingested_at"), f"{tmp_path}/episodes")
    files = [f for f in (tmp_path / "episodes").iterdir() if f.name.startswith("part-")]
    assert tally == (20, 20) and files and all(f.name.endswith(".json.gz") for f in files)
    assert sorted(spark.read.schema(rows.schema).json(f"{tmp_path}/episodes").collect()) == sorted(rows.collect())
