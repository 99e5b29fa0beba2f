"""The memory under a folder: batches, keyed upserts, links, scopes, watched folders and streams, each also broken off halfway."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from notegraph.catalog import Scope
from notegraph.functions import defaults
from notegraph.functions.embedding import embedding
from notegraph.models import HashEmbedder
from notegraph.plans import ingest as plan
from notegraph.plans.memory import link, of_project, reflect, relations
from notegraph.plans.search import Search, SearchOptions, SearchRequest
from notegraph.storage import committed, latest
from notegraph.schemas import MEMORY
from notegraph.streaming import streams

NOW, LATER = "2024-02-01 00:00:00", "2024-02-02 00:00:00"
EPISODES = "episode_id string, project_id string, content string, extraction string"


def said(notes, entities=(), relationships=(), gone=()):
    triple = lambda t: {"from": t[0], "to": t[1], "relation": t[2], "properties": {"t": t[2]}}
    return json.dumps({"notes": [{"content": n, "kind": "Decision"} for n in notes], "entities": [{"name": n, "kind": k} for n, k in entities], "relationships": [triple(t) for t in relationships], "supersedesPriorEdges": [triple(t) for t in gone]})


def put(spark, root, rows, now=NOW, **options):
    return plan.store(spark, root, spark.createDataFrame([(i, p, "c", x) for i, p, x in rows], EPISODES), now, **options)


def shown(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_store(spark, tmp_path):
    root = str(tmp_path)
    assert put(spark, root, [("a", "p", said(["one two", "three"], [("Ann", ""), (" \t\n ", "k"), ("Bob", None), ("bob", "b"), ("BOB", "c")], [("ANN", "bob", "KNOWS")])), ("b", "p", said([" \t"])), ("c", "p", "no json")], writer="w", epoch=3) == 1
    whole = relations(spark, root)
    assert shown(whole["notes"], "note_id", "episode_id", "kind") == [("a/0", "a", 2), ("a/1", "a", 2)]
    assert shown(whole["entities"], "name", "kind") == [("Ann", "concept"), ("BOB", "c"), ("Bob", "concept"), ("bob", "b")]
    names = {r["entity_id"]: r["name"] for r in whole["entities"].collect()}
    (edge,) = whole["edges"].collect()
    assert (names[edge["from_id"]], names[edge["to_id"]]) == ("Ann", "BOB")  # of names that differ in case the last
    vectors = whole["note_embeddings"].collect()
    assert {r["note_id"] for r in vectors} == {"a/0", "a/1"} and {(r["embedding_model"], r["dimensions"], len(r["embedding"])) for r in vectors} == {("hash-64", 64, 64)}
    assert whole["note_entity_mentions"].count() == 8
    assert put(spark, root, [("z", "p", said(["again"]))], writer="w", epoch=3) is None and relations(spark, root)["notes"].count() == 2


def test_upserts_write_what_they_touch(spark, tmp_path):
    root = str(tmp_path)
    many = [(f"e{i}", "p", said(["n"], [(f"N{i}", "old"), (f"M{i}", "old")], [(f"N{i}", f"M{i}", "R")])) for i in range(300)]
    assert put(spark, root, many, buckets=256) == 1
    assert put(spark, root, [("x", "p", said(["n"], [("N7", "new"), ("Q", "new")], [("N7", "Q", "S")], [("N7", "M7", "R")]))], LATER, buckets=256) == 2
    size = lambda name, batch: sum(f.stat().st_size for f in Path(root, name, f"batch={batch}").rglob("*.parquet"))
    assert size("entities", 2) < size("entities", 1) / 20 and size("edges", 2) < size("edges", 1) / 20
    whole = relations(spark, root)
    kinds = {r["name"]: (r["kind"], str(r["first_seen_at"])[:10], str(r["last_seen_at"])[:10]) for r in whole["entities"].collect()}
    assert len(kinds) == 601 and kinds["N7"] == ("new", "2024-02-01", "2024-02-02") and kinds["N8"] == ("old", "2024-02-01", "2024-02-01") and kinds["Q"] == ("new", "2024-02-02", "2024-02-02")
    ids = {r["entity_id"]: r["name"] for r in whole["entities"].collect()}
    edges = {(ids[r["from_id"]], ids[r["to_id"]]): r["invalidated_at"] is None for r in whole["edges"].collect()}
    assert len(edges) == 301 and not edges["N7", "M7"] and edges["N7", "Q"] and edges["N8", "M8"]
    assert latest(spark, root, "entities", MEMORY["entities"], []).isEmpty()


def test_links_and_scopes(spark, tmp_path):
    """String ids link within their project; a copy is superseded by the older one, and of copies in one batch the least stays."""
    root = str(tmp_path)
    first = put(spark, root, [("a", "p", said(["red green blue", "cars and trains"], [("Ann", "k")])), ("b", "q", said(["red green blue"], [("Bob", "k")]))])
    second = put(spark, root, [("c", "p", said(["red green blue", "red green blue"])), ("d", "q", said(["trains and cars", "trains and cars", "cars trains"]))])
    assert link(spark, root, first, NOW) is not None and link(spark, root, second, LATER) is not None and link(spark, root, second, LATER) is None
    whole = relations(spark, root)
    assert shown(whole["notes"].filter("superseded_at is not null"), "note_id") == [("c/0",), ("c/1",), ("d/1",)]
    pairs = whole["note_relations"].collect()
    project = {r["note_id"]: r["project_id"] for r in whole["notes"].collect()}
    assert pairs and all(project[r["source_id"]] == project[r["target_id"]] == r["project_id"] for r in pairs)
    ask = lambda scope: Search(spark, of_project(spark, root, scope), HashEmbedder(), options=SearchOptions(abstain=False)).run(SearchRequest("red green cars bob ann")).hits.collect()
    for p, own in (("p", {"a/0", "a/1"}), ("q", {"b/0", "d/0", "d/2"})):
        assert {r["note_id"] for r in ask(Scope("o", "u", p))} == own
    assert ask(None) == [] and ask(Scope("o", "u", "nobody")) == []


def test_embedding_column(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", None, "", "b a", "x"] * 50)], "i int, t string")
    got = {r["i"]: r["v"] for r in rows.select("i", embedding(F.col("t"), HashEmbedder(16), call=7).alias("v")).collect()}
    assert got[1] is None and got[2] == [0.0] * 16 and got[0] == got[3] == pytest.approx(HashEmbedder(16).embed(["a b"])[0])


def test_a_failing_embedder_leaves_nothing(spark, tmp_path):
    class Short:
        name, dimensions = "short", 64

        def embed(self, texts):
            return [[0.0] * 63 for _ in texts]

    root = str(tmp_path)
    with pytest.raises(Exception, match="other vectors"):
        put(spark, root, [("a", "p", said(["one"], [("A", "k")]))], embedder=Short())
    assert all(df.isEmpty() for df in relations(spark, root).values())
    assert put(spark, root, [("a", "p", said(["one"], [("A", "k")]))]) == 1


# --- watched folders ---------------------------------------------------------------------------


def test_watched_folder(spark, tmp_path):
    """New and changed files come, older ones too if their time changed; unchanged ones don't; a failing one comes again until it succeeds."""
    folder, root = tmp_path / "w", str(tmp_path / "m")
    extract = lambda c: F.when(c.contains("bad"), F.lit("no json")).otherwise(defaults.extraction(c))
    poll = lambda now=NOW, **k: streams.poll_markdown(spark, str(folder), root, "p", now, **({"extract": extract} | k))
    held = lambda: sorted(r["content"] for r in relations(spark, root)["notes"].collect())
    assert poll() is None  # there is no folder
    (folder / "sub").mkdir(parents=True)
    assert poll() is None
    put_file = lambda name, text, at: ((folder / name).write_text(text), os.utime(folder / name, (at, at)))
    for name, text in (("a.md", "One"), ("sub/b.md", "---\nid: 1\n---\nTwo"), ("blank.md", " \n"), ("fails.md", "bad Three"), ("other.txt", "Four")):
        put_file(name, text, 1_700_000_000)
    assert poll() is not None and held() == ["One", "Two"]
    seen = committed(spark, root, "seen_files", streams.SEEN)
    assert sorted(Path(r["path"]).name for r in seen.collect()) == ["a.md", "b.md", "blank.md"]
    assert [Path(p).name for p in streams.due_files(spark, str(folder), root)] == ["fails.md"]
    put_file("a.md", "One changed", 1_700_000_060)
    put_file("sub/b.md", "Two older", 1_600_000_000)
    poll(LATER)
    assert held() == ["One", "One changed", "Two", "Two older"]
    poll(LATER, extract=defaults.extraction)  # the failing file succeeds now
    assert held() == ["One", "One changed", "Two", "Two older", "bad Three"]
    assert poll(LATER) is None
    put_file("sub/b.md", "---\nid: 1\n---\nTwo", 1_700_000_000)  # back at a time that was seen before the last
    poll(LATER, gate=lambda told: told.select("episode_id", F.lit(False).alias("save"), F.lit(0.0).alias("score")))
    assert len(held()) == 5 and poll(LATER) is None  # left out by the gate, and recorded


def test_a_poll_that_breaks_off_counts_nothing(spark, tmp_path, monkeypatch):
    folder, root = tmp_path / "w", str(tmp_path / "m")
    folder.mkdir()
    (folder / "a.md").write_text("One")
    monkeypatch.setattr(plan, "commit", breaking(plan.commit))
    with pytest.raises(RuntimeError, match="broken off"):
        streams.poll_markdown(spark, str(folder), root, "p", NOW)
    assert relations(spark, root)["notes"].isEmpty() and committed(spark, root, "seen_files", streams.SEEN).isEmpty()
    assert streams.poll_markdown(spark, str(folder), root, "p", NOW) == 1 and relations(spark, root)["notes"].count() == 1


# --- streams -----------------------------------------------------------------------------------


def breaking(commit):
    """commit() that breaks off once, when all is staged and nothing is committed."""
    left = [1]

    def run(spark, root, tables, batch, *, keyed=None, **options):
        if not left:
            return commit(spark, root, tables, batch, keyed=keyed, **options)
        left.clear()
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")
        for name, df in (keyed or {}).items():
            df.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/{name}/batch={batch}")
        raise RuntimeError("broken off")

    return run


def test_webhooks_end_in_notes_once(spark, tmp_path, monkeypatch):
    """A run that breaks off between staging and commit and is then repeated, with deliveries that come twice, equals one batch of all."""
    inbox, root, whole = tmp_path / "in", str(tmp_path / "m"), str(tmp_path / "whole")
    inbox.mkdir()
    request = lambda i, body, name="hook": json.dumps({"delivery_id": f"d{i}", "at": f"2024-02-01T00:0{i}:00Z", "project_id": "p", "name": name, "body": body})
    (inbox / "1.json").write_text("\n".join([request(1, "Ann met Bob."), request(2, '{"content": "Cid left."}'), request(2, '{"content": "Cid left."}'), request(3, " "), request(4, "x", "")]))
    run = lambda: streams.take_in(streams.webhook_stream(spark, str(inbox)), root, str(tmp_path / "c"), writer="hooks", now=NOW).awaitTermination()
    monkeypatch.setattr(plan, "commit", breaking(plan.commit))
    with pytest.raises(Exception, match="broken off"):
        run()
    assert relations(spark, root)["notes"].isEmpty()
    run()
    assert relations(spark, root)["notes"].count() == 2
    (inbox / "2.json").write_text("\n".join([request(1, "Ann met Bob."), request(5, "Bob met Dan.")]))  # the first comes again in a later micro-batch
    run()
    run()
    plain = [("d1", "Ann met Bob."), ("d2", "Cid left."), ("d5", "Bob met Dan.")]
    once = spark.createDataFrame(plain, "episode_id string, content string").select("episode_id", F.lit("p").alias("project_id"), "content", defaults.extraction(F.col("content")).alias("extraction"))
    assert plan.store(spark, whole, once, NOW) == 1
    got, want = relations(spark, root), relations(spark, whole)
    for name, columns in (("notes", ["note_id", "content"]), ("entities", ["name", "entity_id"]), ("note_entity_mentions", ["note_id", "entity_id"]), ("note_embeddings", ["note_id", "embedding"])):
        assert shown(got[name], *columns) == shown(want[name], *columns) and got[name].count() > 0, name


def test_watching_polls_until_it_is_stopped(spark, tmp_path):
    polled = []
    q = streams.watching(spark, lambda: polled.append(1), str(tmp_path / "c"), every="0 seconds")
    try:
        for _ in range(60):
            if len(polled) > 1:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    assert len(polled) > 1


def test_reflections_of_all_projects(spark, tmp_path):
    """One failing project leaves the others' reflections; a run counts once, and the next one takes the failed project in."""

    class Wary:
        name, broken = "wary", True

        def summarise(self, scope, body):
            if self.broken and "bad" in body:
                raise ValueError("no")
            return f"{scope}: {body.count(chr(10) + '- ')}"

    root, projects = str(tmp_path), spark.createDataFrame([("p",), ("q",), ("r",), ("p",), (None,)], "project_id string")
    put(spark, root, [("a", "p", said(["one", "two"])), ("b", "q", said(["bad"]))])
    writer = Wary()
    assert reflect(spark, root, projects, "weekly", LATER, writer, epoch=1) is not None and reflect(spark, root, projects, "weekly", LATER, writer, epoch=1) is None
    whole = relations(spark, root)
    assert shown(whole["reflections"], "project_id", "scope", "summary", "generator_model") == [("p", "weekly", "weekly: 2", "wary")]
    assert shown(whole["reflection_runs"], "project_id", "status", "n") == [("p", "written", 2), ("q", "failed", 1), ("r", "empty", 0)]
    writer.broken = False
    assert reflect(spark, root, projects, "weekly", LATER, writer, epoch=2) is not None
    assert shown(relations(spark, root)["reflections"], "project_id", "summary") == [("p", "weekly: 2"), ("p", "weekly: 2"), ("q", "weekly: 1")]
