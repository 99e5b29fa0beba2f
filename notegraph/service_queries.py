"""Queries of the service's calls: writes, lists and views, tenants, keys, backups, defaults of models. They join those of queries.py."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from notegraph import adapters as a
from notegraph.catalog import Scope
from notegraph.functions import defaults, scalars as f
from notegraph.models import FirstLines, HashEmbedder
from notegraph.operators import accounts, graph, lexical, memory, mutations
from notegraph.plans import textindex, views
from notegraph.plans.ingest import ingest, parsed, store
from notegraph.plans.memory import link, of_project, relations
from notegraph.plans.search import Search, SearchOptions, SearchRequest
from notegraph.queries import NOW, ORACLE, QUERIES, TERMS, V_EDGES, V_NOTES, V_REFLECTIONS, _active, _fused, _KNN, _r, _stamp, _vec, _vector, query
from notegraph.schemas import CASCADE, SET_NULL
from notegraph.sources import backups, requests
from notegraph.storage import shared_dir, stored

__all__ = ["ORACLE", "QUERIES"]

_KIND = "list_extract(['General', 'Observation', 'Decision', 'Learning', 'Error', 'Pattern'], kind + 1)"
_ISO = "'%Y-%m-%dT%H:%M:%S'"
V_EPISODES = "episodes AS (SELECT conv_id || ':' || turn AS episode_id, role AS source, text AS content, TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id * 60 + turn AS INT)) AS ingested_at FROM conversations)"
#: When entities were last seen: the start of the last of their edges.
V_SEEN = "seen AS (SELECT entity_id, name, kind, max(valid_from) AS last_seen_at FROM entities LEFT JOIN edges ON from_id = entity_id GROUP BY ALL)"


def _at(spark, name: str) -> str:
    """A folder of this run's own."""
    return f"{shared_dir(spark)}/notegraph/{name}-{uuid.uuid4().hex}"


def _seen(spark, sf):
    last = a.edges(spark, sf).groupBy(F.col("from_id").alias("entity_id")).agg(F.max("valid_from").alias("last_seen_at"))
    return a.entities(spark, sf).join(last, "entity_id", "left")


def _edges(spark, sf):
    return a.edges(spark, sf).withColumn("edge_id", F.concat_ws(">", "from_id", "relation", "to_id")).withColumn("recorded_at", F.col("valid_from"))


# --- lists and views ---------------------------------------------------------------------------


@query(f"WITH {V_EPISODES} SELECT episode_id AS id, source, content, strftime(ingested_at, '%Y-%m-%d %H:%M:%S') AS \"ingestedAt\" FROM episodes ORDER BY ingested_at DESC, episode_id DESC LIMIT 200")
def episode_list(spark, sf):
    return views.episode_list(a.episodes(spark, sf), 200).select("id", "source", "content", _stamp("ingestedAt"))


@query(f"""WITH {V_NOTES} SELECT CAST(to_json({{'id': note_id, 'content': content, 'contextDescription': context, 'keywords': keywords, 'tags': tags, 'kind': {_KIND}, 'createdAt': strftime(created_at, {_ISO})}}) AS VARCHAR) AS json
 FROM (SELECT * FROM notes ORDER BY created_at DESC, note_id DESC LIMIT 50)""")
def note_list_json(spark, sf):
    return views.as_json(views.note_list(a.raw_notes(spark, sf)))


@query(f"WITH {V_REFLECTIONS} SELECT reflection_id AS id, scope, summary, strftime(generated_at, '%Y-%m-%d %H:%M:%S') AS \"generatedAt\" FROM reflections ORDER BY generated_at DESC, reflection_id DESC LIMIT 20")
def reflection_list(spark, sf):
    return views.reflection_list(a.reflections(spark, sf)).select("id", "scope", "summary", _stamp("generatedAt"))


@query(f"WITH {V_EDGES} SELECT concat_ws('>', from_id, relation, to_id) AS id, from_id AS \"from\", to_id AS \"to\", relation, strftime(valid_from, '%Y-%m-%d %H:%M:%S') AS \"recordedAt\", strftime(invalidated_at, '%Y-%m-%d %H:%M:%S') AS \"invalidatedAt\" FROM edges ORDER BY id LIMIT 200")
def edge_list(spark, sf):
    return views.edge_list(_edges(spark, sf)).select("id", "from", "to", "relation", _stamp("recordedAt"), _stamp("invalidatedAt"))


@query(f"WITH {V_EDGES}, {V_SEEN} SELECT entity_id AS id, name, kind, strftime(last_seen_at, '%Y-%m-%d %H:%M:%S') AS \"lastSeenAt\" FROM seen WHERE contains(lower(name), 'supplier') ORDER BY name, entity_id LIMIT 200")
def entity_list(spark, sf):
    return views.entity_list(_seen(spark, sf), "Supplier", 999).select("id", "name", "kind", _stamp("lastSeenAt"))


@query(f"""WITH {V_NOTES}, {V_EDGES}, {V_REFLECTIONS}, e AS (SELECT * FROM entities WHERE contains(lower(name), 'nation_3') ORDER BY name, entity_id LIMIT 1),
 near AS (SELECT *, strftime(valid_from, {_ISO}) AS v, strftime(invalidated_at, {_ISO}) AS i FROM edges),
 o AS (SELECT near.* FROM near JOIN e ON from_id = entity_id ORDER BY relation, to_id LIMIT 50), n AS (SELECT near.* FROM near JOIN e ON to_id = entity_id ORDER BY relation, from_id LIMIT 50)
 SELECT 'note' AS what, (SELECT CAST(to_json({{'id': note_id, 'content': content, 'contextDescription': context, 'keywords': keywords, 'tags': tags, 'createdAt': strftime(created_at, {_ISO}), 'supersededAt': strftime(superseded_at, {_ISO}), 'sourceEpisodeId': NULL}}) AS VARCHAR) FROM notes WHERE note_id = 7) AS json
 UNION ALL SELECT 'no note', 'null'
 UNION ALL SELECT 'reflection', (SELECT CAST(to_json({{'id': reflection_id, 'scope': scope, 'summary': summary, 'generatedAt': strftime(generated_at, {_ISO}), 'generatorModel': NULL}}) AS VARCHAR) FROM reflections ORDER BY generated_at DESC, reflection_id DESC LIMIT 1)
 UNION ALL SELECT 'entity', (SELECT CAST(to_json({{'entity': {{'id': entity_id, 'name': name, 'kind': kind, 'attributes': NULL, 'firstSeenAt': NULL, 'lastSeenAt': NULL}},
  'outgoing': (SELECT list({{'relation': relation, 'toEntityId': to_id, 'recordedAt': v, 'validFrom': v, 'validTo': NULL, 'invalidatedAt': i}} ORDER BY relation, to_id) FROM o),
  'incoming': (SELECT list({{'relation': relation, 'fromEntityId': from_id, 'recordedAt': v, 'validFrom': v, 'validTo': NULL, 'invalidatedAt': i}} ORDER BY relation, from_id) FROM n)}}) AS VARCHAR) FROM e)""")
def single_views(spark, sf):
    """A note, a missing one, the newest reflection, and an entity with its edges, each as JSON."""
    notes = a.notes(spark, sf)
    shown = {"note": views.note_view(notes, 7), "no note": views.note_view(notes, -7), "reflection": views.latest_reflection(a.reflections(spark, sf)), "entity": views.entity_view(a.entities(spark, sf), _edges(spark, sf), "nation_3")}
    rows = [df.select(F.lit(what).alias("what"), "json") for what, df in shown.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query(f"""WITH {V_NOTES}, {V_EDGES}, {V_SEEN}, {V_REFLECTIONS} SELECT (SELECT count(*) FROM conversations) AS episodes, (SELECT count(*) FROM active) AS active_notes, (SELECT count(*) FROM notes WHERE superseded_at IS NOT NULL) AS superseded_notes,
 (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM reflections) AS reflections, (SELECT string_agg(name || ' ' || kind, ', ' ORDER BY last_seen_at DESC NULLS LAST, name, entity_id) FROM (SELECT * FROM seen ORDER BY last_seen_at DESC NULLS LAST, name, entity_id LIMIT 10)) AS recent""")
def project_overview(spark, sf):
    whole = views.summary(a.episodes(spark, sf), a.notes(spark, sf), _seen(spark, sf), a.reflections(spark, sf))
    return whole.withColumn("recent", F.array_join(F.transform("recent", lambda r: F.concat_ws(" ", r["name"], r["kind"])), ", "))


@query(f"WITH {V_EDGES}, {V_REFLECTIONS} SELECT 'entities' AS what, least(count(*), 500) AS n FROM entities UNION ALL SELECT 'edges', least(count(*), 200) FROM edges UNION ALL SELECT 'reflections', least(count(*), 100) FROM reflections")
def list_counts(spark, sf):
    """Counts of a front page, which are lengths of bounded lists."""
    tables = {"entities": (a.entities, 500), "edges": (a.edges, 200), "reflections": (a.reflections, 100)}
    made = [views.bounded_count(read(spark, sf), most).select(F.lit(what).alias("what"), "n") for what, (read, most) in tables.items()]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query(f"WITH {V_NOTES} SELECT max(n) AS most FROM (SELECT count(*) AS n FROM notes WHERE CAST(created_at AS DATE) BETWEEN DATE '2024-01-06' AND DATE '2024-02-04' GROUP BY CAST(created_at AS DATE) UNION ALL SELECT 0)")
def chart_scale(spark, sf):
    return memory.per_day(a.raw_notes(spark, sf), "created_at", "2024-02-04 12:00:00").agg(F.max("n").alias("most"))


@query(f"WITH {V_EDGES} SELECT from_id, to_id FROM edges WHERE relation = 'SUPPLIES' AND from_id = 's:3' AND valid_from <= TIMESTAMP '1996-06-01' AND invalidated_at IS NULL AND to_id IN (SELECT entity_id FROM entities)")
def edge_scan(spark, sf):
    return graph.scan_edges(a.edges(spark, sf), a.entities(spark, sf), from_id="s:3", relation="SUPPLIES", at="1996-06-01 00:00:00").select("from_id", "to_id")


@query(f"WITH {V_NOTES}, {V_EDGES}, {_vec('v')} SELECT note_id, coalesce(string_agg(DISTINCT entity_id, ',' ORDER BY entity_id), '') AS related FROM v LEFT JOIN mentions USING (note_id) GROUP BY 1")
def related_entities(spark, sf):
    return memory.related_entities(_vector(spark, sf), a.mentions(spark, sf)).select("note_id", F.array_join("related", ",").alias("related"))


# --- writes ------------------------------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 400 ELSE 200 END AS status, CASE WHEN event_id % 3 = 0 THEN 'api' ELSE event_type END AS source, CAST(CASE WHEN event_id % 4 IN (2, 3) THEN 1 ELSE 0 END AS INT) AS n_images,
 CASE event_id % 4 WHEN 0 THEN '  ' WHEN 1 THEN 'c' || event_id WHEN 2 THEN '[image: image/png]' || chr(10) || 'image/png, ' || strlen('i' || event_id) || ' bytes' || chr(10) || chr(10) || chr(10) || 'c' || event_id
  ELSE '[image: title]' || chr(10) || 'image/gif, ' || strlen('i' || event_id) || ' bytes' || chr(10) || chr(10) END AS content FROM events""")
def api_episodes(spark, sf):
    """Requests without anything, with text, with text and images of which one is no base64, and with an image alone."""
    i = F.col("event_id")
    data = F.base64(F.concat(F.lit("i"), i.cast("string")).cast("binary"))
    image = lambda d, mime, title: F.struct(d.alias("data"), F.lit(mime).cast("string").alias("mimeType"), F.lit(title).cast("string").alias("caption"))
    images = F.when(i % 4 == 2, F.array(image(F.lit("no base64!"), None, None), image(data, None, ""))).when(i % 4 == 3, F.array(image(data, "image/gif", "title")))
    content = F.when(i % 4 == 0, "  ").when(i % 4 != 3, F.concat(F.lit("c"), i.cast("string")))
    asked = a.read(spark, sf, "events").select("event_id", F.when(i % 3 != 0, F.col("event_type")).alias("source"), content.alias("content"), images.cast(requests.IMAGES).alias("images"))
    return requests.api_episodes(asked).select("event_id", "status", "source", "n_images", "content")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS occurred_at FROM events")
def save_episodes(spark, sf):
    ts = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    asked = a.read(spark, sf, "events").select("event_id", F.lit("chat").alias("source"), F.col("props").alias("content"), F.when(F.col("event_id") % 2 == 0, ts).otherwise("some day").alias("occurred_at"))
    return requests.save_episodes(asked).select("event_id", _stamp("occurred_at"))


def _ingested(spark, sf):
    """Customers as episodes that tell of a customer, whose kind is fixed, and of a nation, whose kind is the market of the last to say so; those in debt are not important."""
    c = a.read(spark, sf, "customer").join(a.read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    attributes = F.create_map(F.lit("key"), F.col("c_custkey").cast("string"))
    entity = lambda name, kind: F.struct(F.col(name).alias("name"), kind.alias("kind"), attributes.alias("attributes"))
    said = F.struct(
        F.array(F.struct(F.col("c_mktsegment").alias("content"), F.lit("General").alias("kind"))).alias("notes"),
        F.array(entity("c_name", F.lit("customer")), entity("n_name", F.col("c_mktsegment"))).alias("entities"),
        F.array(F.struct(F.col("c_name").alias("from"), F.col("n_name").alias("to"), F.lit("IN").alias("relation"), attributes.alias("properties"))).alias("relationships"),
    )
    at = F.timestamp_add("HOUR", F.col("c_custkey").cast("int"), F.to_timestamp(F.lit(a.EPOCH)))
    episodes = c.select(F.col("c_custkey").alias("episode_id"), F.lit("p").alias("project_id"), F.to_json(said).alias("extraction"), at.alias("ingested_at"))
    judged = c.select(F.col("c_custkey").alias("episode_id"), F.lit(True).alias("save"), F.when(F.col("c_acctbal") < 0, 0.0).otherwise(1.0).alias("score"))
    none = lambda s: spark.createDataFrame([], s)
    entities = none("project_id string, name string, entity_id string, kind string, attributes map<string,string>, first_seen_at timestamp, last_seen_at timestamp")
    edges = none("project_id string, from_id string, to_id string, relation string, edge_id string, recorded_at timestamp, valid_from timestamp, valid_to timestamp, invalidated_at timestamp, source_episode long, properties map<string,string>")
    return episodes, judged, lambda: ingest(episodes, judged, entities, edges, NOW)


@query("""WITH c AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0)
 SELECT c_name AS name, 'customer' AS kind, count(*) AS notes, CAST(max(c_custkey) AS VARCHAR) AS key FROM c GROUP BY c_name UNION ALL SELECT n_name, arg_max(c_mktsegment, c_custkey), count(*), CAST(max(c_custkey) AS VARCHAR) FROM c GROUP BY n_name""")
def ingest_commit(spark, sf):
    """Entities, with their notes, of a batch that was committed whole and then sent again."""
    root = _at(spark, "memory")
    episodes, judged, _ = _ingested(spark, sf)
    for _ in range(2):
        store(spark, root, episodes, NOW, judgments=judged, writer="customers", epoch=1)
    whole = relations(spark, root)
    entities, counted = whole["entities"], whole["note_entity_mentions"]
    counted = counted.groupBy("entity_id").agg(F.count("*").alias("notes"))
    return entities.join(counted, "entity_id").select("name", "kind", "notes", F.col("attributes")["key"].alias("key"))


@query("""SELECT c_name AS from_name, n_name AS to_name, 'IN' AS relation, CAST(c_custkey AS VARCHAR) AS key, c_custkey AS source FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0""")
def ingest_edges(spark, sf):
    """Edges of an ingest with their properties and source episodes."""
    done = _ingested(spark, sf)[2]()
    name = lambda side: done.entities.select(F.col("entity_id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"))
    return done.edges.join(name("from"), "from_id").join(name("to"), "to_id").select("from_name", "to_name", "relation", F.col("properties")["key"].alias("key"), F.col("source_episode").alias("source"))


_NEW = f"SELECT source_id, target_id, greatest(0, 1 - d) AS similarity FROM k JOIN notes s ON s.note_id = source_id WHERE s.created_at >= TIMESTAMP '2024-01-08' AND greatest(0, 1 - d) >= 0.30"


def _links(spark, sf):
    new = a.raw_notes(spark, sf).filter("created_at >= timestamp '2024-01-08'")
    return stored(memory.link(a.note_embeddings(spark, sf), a.notes(spark, sf), new=new), "links")


@query(f"WITH {V_NOTES}, {_KNN} SELECT source_id, target_id, round(similarity, 6) AS similarity FROM ({_NEW})")
def link_new(spark, sf):
    """Links of the notes since a time, against all: what a batch of new notes needs."""
    return _links(spark, sf).select("source_id", "target_id", _r("similarity"))


@query(f"""WITH {V_NOTES}, {_KNN}, l AS ({_NEW}), j AS (SELECT source_id, target_id, CASE WHEN x.content = y.content THEN 'duplicates' ELSE 'related-to' END AS relation_type, CASE WHEN x.content = y.content THEN 1 ELSE similarity END AS confidence
 FROM l JOIN notes x ON x.note_id = source_id JOIN notes y ON y.note_id = target_id) SELECT source_id, target_id, relation_type, round(confidence, 6) AS confidence, confidence >= 0.60 AS kept FROM j""")
def link_default(spark, sf):
    """Links of new notes as the judge that needs no model sees them, and which are sure enough to stay."""
    links, notes = _links(spark, sf), a.raw_notes(spark, sf)
    judged = memory.judge(links, notes)
    kept = memory.judged_links(links, judged, links.select("source_id", "target_id").limit(0)).select("source_id", "target_id", F.lit(True).alias("kept"))
    return judged.join(kept, ["source_id", "target_id"], "left").select("source_id", "target_id", "relation_type", _r("confidence"), F.coalesce("kept", F.lit(False)).alias("kept"))


# --- defaults of models ------------------------------------------------------------------------

_SAID = r"""list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]+[ \t\r\n]+'), lambda s: trim(s, ' ' || chr(9) || chr(13) || chr(10))), lambda s: s <> '')"""


@query(rf"""SELECT doc_id, len(s) > 0 AS ok, CAST(least(len(s), 5) AS INT) AS notes, s[1] AS first, CASE WHEN len(s) > 5 THEN array_to_string(s[5:], '. ') ELSE s[5] END AS fifth, CAST(CASE WHEN len(s) > 0 THEN len(list_distinct(regexp_extract_all(text, '\p{{Lu}}[\p{{L}}\p{{N}}]+( \p{{Lu}}[\p{{L}}\p{{N}}]+)*'))) ELSE 0 END AS INT) AS entities
 FROM (SELECT doc_id, text, {_SAID} AS s FROM documents)""")
def extract_default(spark, sf):
    """Extractions made without a model, as ingest reads them."""
    told = a.read(spark, sf, "documents").select("doc_id", defaults.extraction(F.col("text")).alias("extraction"))
    n = F.col("x.notes")
    return parsed(told).select("doc_id", "ok", F.coalesce(F.size(n), F.lit(0)).alias("notes"), F.get(n, F.lit(0))["content"].alias("first"), F.get(n, F.lit(4))["content"].alias("fifth"), F.coalesce(F.size("x.entities"), F.lit(0)).alias("entities"))


@query(rf"""WITH {V_NOTES}, w AS (SELECT * FROM (SELECT * FROM active ORDER BY created_at DESC, note_id DESC LIMIT 30)),
 q AS (SELECT note_id, content, array_to_string(list_filter(regexp_split_to_array(lower(content), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')[1:8], ' ') AS q FROM w)
 SELECT note_id, q || '?' AS query, substring(content, 1, 120) AS preview FROM q WHERE q <> ''""")
def eval_requests(spark, sf):
    return requests.eval_requests(a.notes(spark, sf))


_LAST_WEEK = "w AS (SELECT * FROM active WHERE created_at BETWEEN TIMESTAMP '2024-01-05' - INTERVAL 7 DAY AND TIMESTAMP '2024-01-05' ORDER BY created_at DESC, note_id DESC LIMIT 30)"


@query(f"""WITH {V_NOTES}, {V_REFLECTIONS}, {_LAST_WEEK}, m AS (SELECT * FROM reflections WHERE scope <> 'meta' AND generated_at BETWEEN TIMESTAMP '{NOW}' - INTERVAL 90 DAY AND TIMESTAMP '{NOW}' ORDER BY generated_at DESC, reflection_id DESC LIMIT 30),
 b AS (SELECT 'recent' AS scope, TIMESTAMP '2024-01-05' AS made, 'Reflect on these ' || count(*) || ' recent notes (most recent first):' || chr(10) || chr(10) || string_agg('- [' || strftime(created_at, '%Y-%m-%d') || '] (' || context || ') ' || content, chr(10) ORDER BY created_at DESC, note_id DESC) AS body FROM w HAVING count(*) > 0
  UNION ALL SELECT 'meta', TIMESTAMP '{NOW}', 'Synthesize across these ' || count(*) || ' reflections (most recent first):' || chr(10) || chr(10) || string_agg('--- [' || strftime(generated_at, '%Y-%m-%d') || '] scope=' || scope || ' ---' || chr(10) || summary || chr(10), chr(10) ORDER BY generated_at DESC, reflection_id DESC) FROM m HAVING count(*) > 0)
 SELECT scope, strftime(made, '%Y-%m-%d %H:%M:%S') AS generated_at, 'first-lines' AS generator_model, scope || ': ' || array_to_string(list_transform(string_split(body, chr(10))[1:3], lambda l: substring(l, 1, 80)), ' / ') AS summary FROM b""")
def reflect_write(spark, sf):
    """Rows that a reflection on notes, one on reflections, and one without notes write."""
    notes, old = a.notes(spark, sf), a.reflections(spark, sf)
    made = [memory.reflect(notes, old, scope, now, FirstLines())[0] for scope, now in (("recent", "2024-01-05 00:00:00"), ("meta", NOW), ("recent", "1990-01-01 00:00:00"))]
    return made[0].unionByName(made[1]).unionByName(made[2]).select("scope", _stamp("generated_at"), "generator_model", "summary")


class _Wary(FirstLines):
    """Refuses sources of one tenant."""

    def summarise(self, scope, body):
        if "src7" in body:
            raise ValueError("not this one")
        return super().summarise(scope, body)


@query(f"""WITH {V_NOTES}, p AS (SELECT DISTINCT source AS project_id FROM documents UNION SELECT 'nobody'),
 w AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, note_id DESC) AS place FROM active WHERE created_at BETWEEN TIMESTAMP '2024-01-07' - INTERVAL 7 DAY AND TIMESTAMP '2024-01-07'),
 b AS (SELECT project_id, count(*) AS n, string_agg('- [' || strftime(created_at, '%Y-%m-%d') || '] (' || project_id || ') ' || content, chr(10) ORDER BY created_at DESC, note_id DESC) AS body FROM w WHERE place <= 30 GROUP BY 1),
 t AS (SELECT project_id, coalesce(n, 0) AS n, 'Reflect on these ' || n || ' recent notes (most recent first):' || chr(10) || chr(10) || body AS body FROM p LEFT JOIN b USING (project_id))
 SELECT project_id, CASE WHEN n = 0 THEN 'empty' WHEN contains(body, 'src7') THEN 'failed' ELSE 'written' END AS status, n, CASE WHEN NOT contains(body, 'src7') THEN 'weekly: ' || array_to_string(list_transform(string_split(body, chr(10))[1:3], lambda l: substring(l, 1, 80)), ' / ') END AS summary,
  CASE WHEN contains(body, 'src7') THEN 'ValueError: not this one' END AS error FROM t""")
def reflect_all(spark, sf):
    """A week's reflections of all tenants at once; the writer fails for one, and one has no notes."""
    notes = a.notes(spark, sf).withColumn("context", F.col("project_id"))
    projects = notes.select("project_id").unionByName(spark.createDataFrame([("nobody",)], "project_id string"))
    return memory.reflect_all(projects, notes, "weekly", "2024-01-07 00:00:00", _Wary()).select("project_id", "status", "n", "summary", "error")


# --- tenants, keys, backups --------------------------------------------------------------------


@query("""SELECT 'organizations' AS relation, count(DISTINCT r_name) AS n, max(lower(replace(replace(r_name, ' ', '-'), '_', '-'))) AS most FROM region UNION ALL SELECT 'users', count(*), max('n' || n_nationkey || '@x') FROM nation
 UNION ALL SELECT 'memberships', count(*), '0' FROM nation UNION ALL SELECT 'projects', count(*), max(lower(replace(replace(n_name, ' ', '-'), '_', '-'))) FROM nation""")
def bootstrap(spark, sf):
    """Regions as organizations, with a user and a project for each nation."""
    asked = a.read(spark, sf, "nation").join(a.read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    made = accounts.bootstrap(asked.select(F.col("r_name").alias("org_name"), F.format_string("n%d@x", "n_nationkey").alias("user_email"), F.col("n_name").alias("user_name"), F.col("n_name").alias("project_name"), F.lit("hash-64").alias("embedding_model")), NOW)
    shown = {"organizations": "slug", "users": "email", "memberships": "role", "projects": "slug"}
    rows = [made[n].agg(F.lit(n).alias("relation"), F.count("*").alias("n"), F.max(F.col(c).cast("string")).alias("most")) for n, c in shown.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("""SELECT c_custkey AS id, sha256('memk_' || replace(replace(rtrim(base64(unhex(sha256('k' || c_custkey))), '='), '+', '-'), '/', '_')) AS key_hash, CASE WHEN c_custkey % 5 = 0 THEN 'unnamed' ELSE c_name END AS name,
 CASE WHEN c_custkey % 7 = 0 THEN 'admin' ELSE 'tenant' END AS role, c_custkey % 3 <> 0 AS live, CASE WHEN c_custkey % 2 = 0 THEN '2024-02-20 00:00:00' END AS last_used_at FROM customer""")
def key_lifecycle(spark, sf):
    """Keys made, used, and revoked, some of them twice, as the list shows them."""
    i, at = F.col("c_custkey"), lambda day: F.to_timestamp(F.lit(f"2024-02-{day} 00:00:00"))
    raw = F.unhex(F.sha2(F.concat(F.lit("k"), i.cast("string")), 256))
    asked = a.read(spark, sf, "customer").select(i.alias("id"), accounts.token(raw).alias("token"), F.lit("o").alias("organization_id"), F.lit("p").alias("project_id"), F.lit("u").alias("created_by_user_id"), F.when(i % 5 != 0, F.col("c_name")).alias("name"), F.when(i % 7 == 0, True).alias("is_admin"))
    keys = accounts.key_rows(asked, NOW)
    used = keys.filter("id % 2 = 0").select("key_hash", F.explode(F.array(at(20), at(18))).alias("used_at"))
    gone = keys.filter("id % 3 = 0").select("id")
    keys = mutations.revoke(mutations.revoke(accounts.touch(keys, used), gone, "2024-02-21 00:00:00"), gone, "2024-02-22 00:00:00")
    return accounts.key_list(keys).join(keys.select("id", "key_hash"), "id").select("id", "key_hash", "name", "role", "live", _stamp("last_used_at"))


@query("""SELECT md5('o' || n_nationkey) AS organization_id, 'org_' || substring(md5('o' || n_nationkey), 1, 12) AS schema_name, CASE n_nationkey % 3 WHEN 0 THEN 'provisioned' WHEN 1 THEN 'active' ELSE 'deactivated' END AS status, n_nationkey % 3 = 1 AND n_nationkey % 2 = 0 AS refused
 FROM nation WHERE n_nationkey % 2 = 1 OR n_nationkey % 3 = 1""")
def schema_registry(spark, sf):
    """Organizations provisioned, twice, in three states; half are to be dropped, of which active ones are refused."""
    n = F.col("n_nationkey")
    orgs = a.read(spark, sf, "nation").select("n_nationkey", F.md5(F.concat(F.lit("o"), n.cast("string"))).alias("id"))
    registry = accounts.provision(accounts.provision(backups.empty(spark, "tenant_schemas"), orgs, NOW), orgs, NOW)
    registry = registry.join(orgs.withColumnRenamed("id", "organization_id"), "organization_id").withColumn("status", (n % 3).cast("short")).drop("n_nationkey")
    left, refused = accounts.drop_schemas(registry, orgs.filter(n % 2 == 0))
    hit = refused.select("organization_id", F.lit(True).alias("refused"))
    return accounts.schema_list(left).join(hit, "organization_id", "left").select("organization_id", "schema_name", "status", F.coalesce("refused", F.lit(False)).alias("refused"))


def _tenants(spark, sf):
    """Regions as organizations, nations as projects, customers as members of their nation's region, orders as episodes of their customer's nation."""
    s, at = lambda c: F.col(c).cast("string"), F.to_timestamp(F.lit(NOW))
    t = lambda n: a.read(spark, sf, n)
    home = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return {
        "organizations": t("region").select(s("r_regionkey").alias("id"), F.lower("r_name").alias("slug"), F.col("r_name").alias("name"), at.alias("created_at")),
        "users": t("customer").select(s("c_custkey").alias("id"), F.col("c_name").alias("email"), F.col("c_name").alias("display_name"), at.alias("created_at")),
        "memberships": home.select(s("n_regionkey").alias("organization_id"), s("c_custkey").alias("user_id"), F.lit(2).cast("short").alias("role"), at.alias("granted_at")),
        "projects": t("nation").select(s("n_nationkey").alias("id"), s("n_regionkey").alias("organization_id"), F.lower("n_name").alias("slug"), F.col("n_name").alias("name"), F.lit("m").alias("embedding_model"), at.alias("created_at")),
        "episodes": t("orders").join(home, F.col("o_custkey") == F.col("c_custkey")).select(s("o_orderkey").alias("id"), s("c_nationkey").alias("project_id"), F.lit("order").alias("source"), F.col("o_orderpriority").alias("content"), F.col("o_orderdate").cast("timestamp").alias("ingested_at")),
    }


@query("""WITH h AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 3), d AS (
  SELECT 'organizations' AS relation, count(*) AS rows FROM region WHERE r_regionkey = 3 UNION ALL SELECT 'users', count(DISTINCT c_custkey) FROM h UNION ALL SELECT 'memberships', count(*) FROM h
  UNION ALL SELECT 'projects', count(*) FROM nation WHERE n_regionkey = 3 UNION ALL SELECT 'episodes', count(*) FROM orders JOIN h ON o_custkey = c_custkey)
 SELECT 'dumped' AS step, relation, rows, rows AS active FROM d UNION ALL SELECT 'restored', relation, rows, rows FROM d WHERE relation <> 'episodes' UNION ALL SELECT 'restored again', relation, rows, 0 FROM d WHERE relation <> 'episodes'""")
def tenant_dump(spark, sf):
    """One organization dumped, restored to empty relations, and once more over that."""
    path = _at(spark, "dump")
    dumped = backups.dump(_tenants(spark, sf), "3", path)
    first, restored = backups.restore(spark, path, {n: backups.empty(spark, n) for n in backups.RESTORED})
    _, again = backups.restore(spark, path, first)
    of = lambda step, df: df.select(F.lit(step).alias("step"), "relation", "rows", "active")
    return of("dumped", dumped).unionByName(of("restored", restored)).unionByName(of("restored again", again))


@query(f"""WITH {V_NOTES}, {V_EDGES}, {V_REFLECTIONS} SELECT 'episodes' AS relation, count(*) AS rows, count(*) AS active FROM conversations UNION ALL SELECT 'notes', count(*), count(*) - count(superseded_at) FROM notes
 UNION ALL SELECT 'note_embeddings', count(*), count(*) FROM embeddings UNION ALL SELECT 'note_entity_mentions', count(*), count(*) FROM mentions UNION ALL SELECT 'note_relations', count(*), count(*) FROM labels
 UNION ALL SELECT 'reflections', count(*), count(*) FROM reflections UNION ALL SELECT 'entities', count(*), count(*) FROM entities UNION ALL SELECT 'edges', count(*), count(*) - count(invalidated_at) FROM edges UNION ALL SELECT 'notes-md', count(*), count(*) FROM active""")
def backup_whole(spark, sf):
    """The manifest of a whole backup, whose image embeddings are none."""
    relations = {
        "episodes": a.episodes(spark, sf), "notes": a.notes(spark, sf), "note_embeddings": a.note_embeddings(spark, sf), "note_entity_mentions": a.mentions(spark, sf), "note_relations": a.read(spark, sf, "labels"),
        "reflections": a.reflections(spark, sf), "image_embeddings": a.image_embeddings(spark, sf).limit(0), "entities": a.entities(spark, sf), "edges": a.edges(spark, sf),
    }
    return backups.backup(relations, _at(spark, "backup"))


# --- from texts to a search --------------------------------------------------------------------

_HASHED = """word AS (SELECT note_id, project_id, unnest(list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS w FROM note),
 spot AS (SELECT note_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS i, sum(CASE WHEN substr(md5(w), 9, 1) >= '8' THEN 1 ELSE -1 END) AS n FROM word GROUP BY 1, 2),
 size AS (SELECT note_id, sqrt(sum(n * n)::DOUBLE) AS norm FROM spot GROUP BY 1 HAVING sum(n * n) > 0),
 vec AS (SELECT note_id, i, CAST(CAST(n / norm AS FLOAT) AS DOUBLE) AS x FROM spot JOIN size USING (note_id))"""
_ASKED = "the and of"


@query(f"""WITH {V_EPISODES}, said AS (SELECT episode_id, source, content AS text, split_part(episode_id, ':', 2)::INT >= 2 AS late, {_SAID.replace('text', 'content')} AS s FROM episodes),
 cut AS (SELECT episode_id, source, late, text, CASE WHEN len(s) > 5 THEN list_append(s[1:4], array_to_string(s[5:], '. ')) ELSE s END AS s FROM said WHERE len(s) > 0),
 every AS (SELECT episode_id || '/' || (i - 1) AS note_id, source AS project_id, late, s[i] AS content, len(list_distinct(regexp_extract_all(text, '\\p{{Lu}}[\\p{{L}}\\p{{N}}]+( \\p{{Lu}}[\\p{{L}}\\p{{N}}]+)*'))) AS entities FROM cut, unnest(range(1, len(s) + 1)) r(i)),
 note AS (SELECT *, row_number() OVER (PARTITION BY project_id, content ORDER BY late, note_id) = 1 AS stays FROM every), {_HASHED},
 q AS (SELECT i, CAST(CAST(n / sqrt(sum(n * n) OVER ()) AS FLOAT) AS DOUBLE) AS x FROM (SELECT CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS i, sum(CASE WHEN substr(md5(w), 9, 1) >= '8' THEN 1 ELSE -1 END) AS n FROM (SELECT unnest(['the', 'and', 'of']) AS w) GROUP BY 1)),
 own AS (SELECT * FROM note WHERE stays AND project_id = 'assistant'),
 dist AS (SELECT note_id, 1 - coalesce(sum(vec.x * q.x), 0) / (sqrt(sum(vec.x * vec.x)) * (SELECT sqrt(sum(x * x)) FROM q)) AS d FROM vec LEFT JOIN q USING (i) WHERE note_id IN (SELECT note_id FROM own) GROUP BY 1),
 v AS (SELECT note_id, CAST(row_number() OVER (ORDER BY round(d, 12), note_id) AS INT) AS rank FROM (SELECT * FROM dist ORDER BY round(d, 12), note_id LIMIT 40)),
 hit AS (SELECT note_id, sum(CASE WHEN w = 'the' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN w = 'and' THEN 1 ELSE 0 END) AS b, sum(CASE WHEN w = 'of' THEN 1 ELSE 0 END) AS c FROM word WHERE note_id IN (SELECT note_id FROM own) GROUP BY 1),
 lex AS (SELECT note_id, CAST(row_number() OVER (ORDER BY a + b + c DESC, note_id) AS INT) AS rank FROM (SELECT * FROM hit WHERE a > 0 AND b > 0 AND c > 0 ORDER BY a + b + c DESC, note_id LIMIT 40)), {_fused('p', vector='v', lexical='lex')}
 SELECT note_id, round(score, 9) AS score, position, content, CAST(entities AS BIGINT) AS entities, (SELECT count(*) FROM own) AS active FROM p JOIN own USING (note_id) WHERE position <= 10""")
def ingest_search(spark, sf):
    """Turns of conversations, in two batches and then the first again, extracted, embedded, committed and linked, and a search in one project over what is committed."""
    root, said = _at(spark, "memory"), a.episodes(spark, sf)
    told = said.select("episode_id", F.col("source").alias("project_id"), "source", "content", "ingested_at", defaults.extraction(F.col("content")).alias("extraction"))
    late = F.split("episode_id", ":")[1].cast("int") >= 2
    for epoch, rows in ((1, told.filter(~late)), (2, told.filter(late)), (1, told.filter(~late))):
        batch = store(spark, root, rows, NOW, writer="turns", epoch=epoch)
        if batch is not None:
            link(spark, root, batch, NOW)
    m = of_project(spark, root, Scope("o", "u", "assistant"))
    m.edges = None  # extraction without a model tells no relationships
    found = Search(spark, m, HashEmbedder(), options=SearchOptions(now=NOW, abstain=False)).run(SearchRequest(_ASKED, max_results=10))
    active = m.notes.filter("superseded_at is null").agg(F.count("*").alias("active"))
    return found.hits.select("note_id", _r("score", 9), "position", "content", F.size("related").cast("long").alias("entities")).crossJoin(F.broadcast(active))  # one row


# --- the stored text index, and cascades -------------------------------------------------------


def _text_index(spark, notes):
    """An index of notes in a folder of this run's own, in two batches."""
    root, first = _at(spark, "index"), F.coalesce(F.col("project_id") < "src2", F.lit(True))
    texts = notes.withColumn("note_id", F.col("note_id").cast("string"))
    for rows in (texts.filter(first), texts.filter(~first)):
        textindex.add(spark, root, rows, 16)
    return textindex.TextIndex(spark, root, whole=True)


def _numbered(posts):
    """Postings whose ids are numbers again, as those of the driver's notes."""
    return posts.withColumn("note_id", F.col("note_id").cast("long"))


@query(ORACLE["lexical_rank"])
def lexical_indexed(spark, sf):
    """lexical_rank by the stored index, of which it reads the buckets of its terms."""
    posts = _numbered(_text_index(spark, a.raw_notes(spark, sf)).postings(TERMS))
    return lexical.top_k_indexed(posts, _active(spark, sf), TERMS, 20).select("rank", "note_id", "score")


@query(ORACLE["okapi_rank"])
def okapi_indexed(spark, sf):
    """okapi_rank by the stored index and the counts beside it."""
    index, asked = _text_index(spark, a.raw_notes(spark, sf)), ["thing", "with"]
    return lexical.okapi_indexed(_numbered(index.postings(asked)), index.counts(asked), index.totals(), asked, 20).select("rank", "note_id", "score")


_TRADE = (
    ("nation", "n_regionkey", "region", CASCADE), ("customer", "c_nationkey", "nation", CASCADE), ("supplier", "s_nationkey", "nation", CASCADE),
    ("orders", "o_custkey", "customer", CASCADE), ("lineitem", "l_orderkey", "orders", CASCADE), ("lineitem", "l_suppkey", "supplier", SET_NULL),
)
_TRADE_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}


@query("""WITH r AS (SELECT r_regionkey AS k FROM region WHERE r_name <> 'EUROPE'), n AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey IN (SELECT k FROM r) OR n_regionkey NOT IN (SELECT r_regionkey FROM region)),
 c AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey IN (SELECT k FROM n) OR c_nationkey NOT IN (SELECT n_nationkey FROM nation)), s AS (SELECT s_suppkey AS k FROM supplier WHERE s_nationkey IN (SELECT k FROM n) OR s_nationkey NOT IN (SELECT n_nationkey FROM nation)),
 o AS (SELECT o_orderkey AS k FROM orders WHERE o_custkey IN (SELECT k FROM c) OR o_custkey NOT IN (SELECT c_custkey FROM customer)),
 l AS (SELECT l_orderkey AS k, l_suppkey IN (SELECT s_suppkey FROM supplier) AND l_suppkey NOT IN (SELECT k FROM s) AS gone FROM lineitem WHERE l_orderkey IN (SELECT k FROM o) OR l_orderkey NOT IN (SELECT o_orderkey FROM orders))
 SELECT 'region' AS relation, count(*) AS n, CAST(sum(k) AS BIGINT) AS keys, CAST(0 AS BIGINT) AS nulled FROM r UNION ALL SELECT 'nation', count(*), CAST(sum(k) AS BIGINT), 0 FROM n UNION ALL SELECT 'customer', count(*), CAST(sum(k) AS BIGINT), 0 FROM c
 UNION ALL SELECT 'supplier', count(*), CAST(sum(k) AS BIGINT), 0 FROM s UNION ALL SELECT 'orders', count(*), CAST(sum(k) AS BIGINT), 0 FROM o UNION ALL SELECT 'lineitem', count(*), CAST(sum(k) AS BIGINT), count_if(gone) FROM l""")
def cascade_all(spark, sf):
    """A region goes, and along all keys its nations, their customers and suppliers, and orders with their lines; lines of other orders lose their supplier alone."""
    tables = {t: a.read(spark, sf, t) for t in _TRADE_KEYS}
    gone = tables["region"].filter("r_name = 'EUROPE'").select("r_regionkey")
    left = mutations.delete(tables, "region", gone, _TRADE, _TRADE_KEYS).relations
    counted = lambda t: left[t].agg(F.lit(t).alias("relation"), F.count("*").alias("n"), F.sum(_TRADE_KEYS[t]).cast("long").alias("keys"), (F.count_if(F.col("l_suppkey").isNull()) if t == "lineitem" else F.lit(0).cast("long")).alias("nulled"))
    return reduce(lambda x, y: x.unionByName(y), map(counted, left))
