"""Scalar functions and connectors on small cases."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from notegraph.catalog import Scope, ScopedCatalog, ScopeRequired
from notegraph.functions import scalars as f
from notegraph.models import HashEmbedder, OverlapScorer, ShortQueryExpander, safe_hints
from notegraph.operators import mutations
from notegraph.plans.ingest import ingest
from notegraph.sources import connectors
from notegraph.streaming import streams


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "slug"),
    [("Hello World", "hello-world"), ("Hello   World", "hello-world"), ("A___B   C", "a-b-c"), ("It's a test!", "its-a-test"), ("", "note"), ("!!!", "note"), ("---", "note"), ("___middle___", "middle"), ("a" * 60, "a" * 40), ("Zażółć gęślą", "zażółć-gęślą")],
)
def test_slug(spark, text, slug):
    assert value(spark, f.slug(F.lit(text))) == slug


def test_key_hash(spark):
    assert value(spark, f.key_hash(F.lit(""))) == hashlib.sha256(b"").hexdigest()
    assert value(spark, f.key_hash(F.lit("ą"))) == hashlib.sha256("ą".encode()).hexdigest()
    assert value(spark, f.bearer(F.lit("BEARER  x "))) == "x" and value(spark, f.bearer(F.lit("Basic x"))) is None


def test_small_functions(spark):
    assert value(spark, f.token_estimate(F.lit(""))) == 0 and value(spark, f.token_estimate(F.lit("x" * 39))) == 11
    assert value(spark, f.yaml_value(F.lit('a: "b\\'))) == '"a: \\"b\\\\"' and value(spark, f.yaml_value(F.lit("plain"))) == "plain"
    assert value(spark, f.kind_code(F.lit("pattern"))) == 5 and value(spark, f.kind_code(F.lit("other"))) is None
    assert value(spark, f.is_uuid(F.lit("0" * 8 + "-0000-0000-0000-" + "0" * 12))) is True and value(spark, f.is_uuid(F.lit("x"))) is False
    assert value(spark, f.split_tags(F.lit(" A, b,,a "))) == ["a", "b"]
    assert value(spark, f.string_map(F.lit('{"a": 1, "b": {"c": 2}, "d": null}'))) == {"a": "1", "b": '{"c":2}', "d": ""}
    assert value(spark, f.frontmatter(F.lit("---\nid: 1\n---\nbody"))) == "id: 1" and value(spark, f.body(F.lit("---\nid: 1\n---\n body "))) == "body"
    assert value(spark, f.body(F.lit("--- no header"))) == "--- no header"


def test_slack(spark):
    sign = "v0=" + hmac.new(b"k", b"v0:100:{}", hashlib.sha256).hexdigest()
    ok = lambda now, s: value(spark, connectors.slack_signed(F.lit("k"), F.lit(100), F.lit("{}"), F.lit(s), F.lit(now)))
    assert ok(300, sign) and not ok(500, sign) and not ok(300, "v0=0")


def test_scope(spark):
    notes = spark.createDataFrame([(1, "a"), (2, "b")], "note_id long, project_id string")
    catalog = ScopedCatalog(spark, {"notes": notes})
    assert catalog.table("notes").count() == 0
    with pytest.raises(ScopeRequired):
        catalog.require()
    assert [r["note_id"] for r in catalog.within(Scope("o", "u", "b")).table("notes").collect()] == [2]


def test_markdown_round_trip(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("---\nid: 1\n---\nHello")
    (tmp_path / "in" / "sub" / "b.md").write_text("  \n")
    got = connectors.markdown_episodes(connectors.markdown_files(spark, str(tmp_path / "in"))).collect()
    assert sorted((r["source"], r["content"], r["status"]) for r in got) == [("md-import:a.md", "Hello", "ok"), ("md-import:b.md", "", "skipped")]


def test_backup_and_restore(spark, tmp_path):
    users = spark.createDataFrame([("1", "a@x"), ("2", "b@x")], "id string, email string")
    manifest = connectors.backup({"users": users}, str(tmp_path / "b")).collect()
    assert [tuple(r) for r in manifest] == [("users", 2, 2)]
    back = connectors.restore(spark, str(tmp_path / "b"), "users", users.filter("id = 1"), ["id"])
    assert sorted(r["id"] for r in back.collect()) == ["1", "2"]


def test_scheduled_jobs_are_isolated():
    done = streams.scheduled(["a", "b"], lambda t: 1 / 0 if t == "a" else t)
    assert isinstance(done["a"], ZeroDivisionError) and done["b"] == "b"


def test_models():
    e = HashEmbedder(16)
    assert e.embed(["a b", "b a"])[0] == e.embed(["b  a"])[0] and len(e.embed([""])[0]) == 16
    assert OverlapScorer().scores("a b", ["b c", ""]) == [0.5, 0.0]
    assert ShortQueryExpander(lambda q: ["Q", " ", "x", "y", "z", "u"]).variants("q") == ["q", "x", "y", "z"]
    assert ShortQueryExpander(lambda q: ["x"]).variants("a b c d e") == ["a b c d e"]
    assert safe_hints(None, "q") == []


def test_upserts(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    old = spark.createDataFrame([("p", "N", "1", "old")], "project_id string, name string, entity_id string, kind string").select("*", F.create_map(F.lit("a"), F.lit("1")).alias("attributes"), at("2024-01-01").alias("first_seen_at"), at("2024-01-01").alias("last_seen_at"))
    new = spark.createDataFrame([("p", "N", "2", "new", 1), ("p", "n", "3", "other", 2)], "project_id string, name string, entity_id string, kind string, seq long").select("*", F.create_map(F.lit("b"), F.lit("2")).alias("attributes"), at("2024-02-01").alias("seen_at"))
    once = mutations.upsert_entities(old, new)
    got = {r["name"]: r for r in once.collect()}
    assert (got["N"]["entity_id"], got["N"]["kind"], got["N"]["attributes"]) == ("1", "new", {"b": "2"}) and got["n"]["entity_id"] == "3"
    again = mutations.upsert_entities(once.select(old.columns), new)
    assert sorted(map(str, again.collect())) == sorted(map(str, once.collect()))


def test_ingest(spark):
    x = '{"notes": [{"content": "n"}], "entities": [{"name": "A"}, {"name": "A"}, {"name": "B"}], "relationships": [{"from": "a", "to": "B", "relation": "R"}, {"from": "a", "to": "C", "relation": "R"}]}'
    episodes = spark.createDataFrame([(1, "p", x), (2, "p", '{"notes": []}'), (3, "p", x)], "episode_id long, project_id string, extraction string")
    judged = spark.createDataFrame([(3, True, 0.1)], "episode_id long, save boolean, score double")
    ents = spark.createDataFrame([], "project_id string, name string, entity_id string, kind string, attributes map<string,string>, first_seen_at timestamp, last_seen_at timestamp")
    edges = spark.createDataFrame([], "project_id string, from_id string, to_id string, relation string, edge_id string, recorded_at timestamp, valid_from timestamp, valid_to timestamp, properties map<string,string>, invalidated_at timestamp")
    out = ingest(episodes, judged, ents, edges, "2024-01-01 00:00:00")
    assert [r["note_id"] for r in out.notes.collect()] == ["1/0"]
    assert sorted(r["name"] for r in out.entities.collect()) == ["A", "B"]
    assert out.mentions.count() == 2 and out.edges.count() == 1
    assert sorted(r["episode_id"] for r in out.skipped.collect()) == [2, 3]


def test_ingest_last_to_arrive_holds(spark):
    """Five episodes say five kinds of one entity and five titles of one edge; arrival counts, not the id."""
    x = '{"notes": [{"content": "n"}], "entities": [{"name": "A", "kind": "k%d"}, {"name": "B"}], "relationships": [{"from": "A", "to": "B", "relation": "R", "properties": {"title": "t%d"}}]}'
    rows = [(i, "p", f"2024-01-0{6 - i} 00:00:00", x % (i, i)) for i in range(1, 6)]
    episodes = spark.createDataFrame(rows, "episode_id long, project_id string, at string, extraction string").withColumn("ingested_at", F.to_timestamp("at"))
    ents = spark.createDataFrame([], "project_id string, name string, entity_id string, kind string, attributes map<string,string>, first_seen_at timestamp, last_seen_at timestamp")
    edges = spark.createDataFrame([], "project_id string, from_id string, to_id string, relation string, edge_id string, recorded_at timestamp, valid_from timestamp, valid_to timestamp, properties map<string,string>, source_episode string, invalidated_at timestamp")
    out = ingest(episodes, None, ents, edges, "2024-02-01 00:00:00")
    assert {r["name"]: r["kind"] for r in out.entities.collect()} == {"A": "k1", "B": "concept"}
    (edge,) = out.edges.collect()
    assert (edge["properties"], edge["source_episode"]) == ({"title": "t1"}, "5")


def test_webhook(spark):
    bodies = ['{"content": "x"}', ' {"meta": {"content": "y"}, "content": "x"}', '{"content": 5, "meta": {"content": "y"}}', '{"content": null}', '["content"]', "plain", '{"content": "x"', " \t", None]
    reqs = spark.createDataFrame([(i, n, b) for i, (n, b) in enumerate([*(("hook", b) for b in bodies), (" \t", "a"), (None, "a"), ("n" * 65, "a")])], "i int, name string, body string")
    got = {r["i"]: r for r in connectors.generic_webhook(reqs).collect()}
    assert [got[i]["content"] for i in range(9)] == ["x", "x", *bodies[2:]]
    assert [i for i in got if got[i]["metadata"]] == [0, 1] and got[0]["metadata"] == {"webhook_raw": bodies[0]}
    assert [got[i]["status"] for i in range(12)] == [200] * 7 + [400] * 5


def test_slug_drops_line_ends(spark):
    assert value(spark, f.slug(F.lit("a\nb c\td"))) == "ab-cd"


def test_supersession_stays_in_its_project(spark):
    """A prior edge is found by parts of names among the project's entities of before, not among others' or this batch's."""
    x = '{"notes": [{"content": "n"}], "entities": [{"name": "Ann Lee Jr"}], "supersedesPriorEdges": [{"from": "ann", "to": "acme", "relation": "R"}]}'
    episodes = spark.createDataFrame([(1, "p", x)], "episode_id long, project_id string, extraction string")
    named = [("q", "Ann A", "0"), ("q", "Acme", "1"), ("p", "Ann Lee", "2"), ("p", "Acme Inc", "3")]
    ents = spark.createDataFrame([(*r, None, None, None, None) for r in named], "project_id string, name string, entity_id string, kind string, attributes map<string,string>, first_seen_at timestamp, last_seen_at timestamp")
    rows = [(p, a, b, "R", e, None, None, None, None, None) for p, a, b, e in (("q", "0", "1", "x"), ("p", "2", "3", "y"))]
    edges = spark.createDataFrame(rows, "project_id string, from_id string, to_id string, relation string, edge_id string, recorded_at timestamp, valid_from timestamp, valid_to timestamp, properties map<string,string>, invalidated_at timestamp")
    out = ingest(episodes, None, ents, edges, "2024-02-01 00:00:00")
    assert {r["edge_id"]: r["invalidated_at"] is None for r in out.edges.collect()} == {"x": True, "y": False}
