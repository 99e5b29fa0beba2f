"""Lists, single items and summaries in the service's field names; as_json() makes each row a JSON document.

An optional column that a relation lacks shows as null.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from notegraph.functions.scalars import kind_name
from notegraph.operators.graph import find_entities
from notegraph.operators.memory import clamp, newest

# The list of edges by default and at most, edges of each direction of an entity, and a summary's entities.
EDGES, MOST_EDGES, PER_DIRECTION, RECENT = 200, 1000, 50, 10
JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"}


def _col(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def as_json(df: DataFrame) -> DataFrame:
    """(json): each row as a document that keeps its null fields."""
    return df.select(F.to_json(F.struct("*"), JSON).alias("json"))


def one_json(df: DataFrame) -> DataFrame:
    """One row (json) for a frame of at most one row: its document, or null as JSON has it."""
    return as_json(df).agg(F.coalesce(F.first("json"), F.lit("null")).alias("json"))


def episode_list(episodes: DataFrame, limit: int = 0) -> DataFrame:
    top = newest(episodes, "ingested_at", "episode_id", limit, "episodes")
    return top.select(F.col("episode_id").alias("id"), "source", "content", F.col("ingested_at").alias("ingestedAt"), _col(top, "occurred_at", "timestamp").alias("occurredAt"))


def note_list(notes: DataFrame, limit: int = 0) -> DataFrame:
    top = newest(notes, "created_at", "note_id", limit, "notes")
    return top.select(F.col("note_id").alias("id"), "content", F.col("context").alias("contextDescription"), "keywords", "tags", kind_name(F.col("kind")).alias("kind"), F.col("created_at").alias("createdAt"))


def _reflection(df: DataFrame) -> DataFrame:
    return df.select(F.col("reflection_id").alias("id"), "scope", "summary", F.col("generated_at").alias("generatedAt"), _col(df, "generator_model").alias("generatorModel"))


def reflection_list(reflections: DataFrame, limit: int = 0) -> DataFrame:
    return _reflection(newest(reflections, "generated_at", "reflection_id", limit, "reflections"))


def edge_list(edges: DataFrame, limit: int = EDGES) -> DataFrame:
    """Edges by id, of 1 to 1000."""
    top = edges.orderBy("edge_id").limit(max(1, min(limit, MOST_EDGES)))
    return top.select(F.col("edge_id").alias("id"), F.col("from_id").alias("from"), F.col("to_id").alias("to"), "relation", _col(top, "recorded_at", "timestamp").alias("recordedAt"), F.col("invalidated_at").alias("invalidatedAt"))


def _entity(df: DataFrame) -> DataFrame:
    seen = [_col(df, c, "timestamp").alias(n) for c, n in (("first_seen_at", "firstSeenAt"), ("last_seen_at", "lastSeenAt"))]
    return df.select(F.col("entity_id").alias("id"), "name", "kind", _col(df, "attributes", "map<string,string>").alias("attributes"), *seen)


def entity_list(entities: DataFrame, text: str | None = None, limit: int = 0) -> DataFrame:
    return _entity(find_entities(entities, text or "", clamp(limit, "entities")))


def note_view(notes: DataFrame, note_id) -> DataFrame:
    """One row (json): the note, null where there is none, an error where ids are UUIDs and this is not one."""
    if isinstance(notes.schema["note_id"].dataType, StringType):
        try:
            note_id = str(uuid.UUID(note_id))
        except ValueError:
            return notes.sparkSession.createDataFrame([('{"error":"invalid uuid"}',)], "json string")
    found = notes.filter(F.col("note_id") == note_id).limit(1)
    gone = _col(found, "superseded_at", "timestamp").alias("supersededAt")
    shown = found.select(F.col("note_id").alias("id"), "content", F.col("context").alias("contextDescription"), "keywords", "tags", F.col("created_at").alias("createdAt"), gone, _col(found, "source_episode_id").alias("sourceEpisodeId"))
    return one_json(shown)


def latest_reflection(reflections: DataFrame) -> DataFrame:
    """One row (json): the newest reflection."""
    return one_json(_reflection(reflections.orderBy(F.desc("generated_at"), F.desc("reflection_id")).limit(1)))


def entity_view(entities: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    """One row (json): the first entity by name that holds text, with fifty edges of each direction by relation and other end."""
    found = find_entities(entities, text, 1)
    own = F.broadcast(found.select("entity_id"))  # one row

    def side(mine: str, other: str, field: str) -> DataFrame:
        stamps = [_col(edges, c, "timestamp").alias(n) for c, n in (("recorded_at", "recordedAt"), ("valid_from", "validFrom"), ("valid_to", "validTo"), ("invalidated_at", "invalidatedAt"))]
        near = edges.join(own, F.col(mine) == F.col("entity_id"), "left_semi").orderBy("relation", other).limit(PER_DIRECTION)
        return near.agg(F.array_sort(F.collect_list(F.struct("relation", F.col(other).alias(field), *stamps))).alias("edges"))

    out, into = (side(*s).withColumnRenamed("edges", n) for s, n in ((("from_id", "to_id", "toEntityId"), "outgoing"), (("to_id", "from_id", "fromEntityId"), "incoming")))
    shown = _entity(found).select(F.struct("*").alias("entity"))
    return one_json(shown.join(F.broadcast(out)).join(F.broadcast(into)).select("entity", "outgoing", "incoming"))  # one row each


def summary(episodes: DataFrame, notes: DataFrame, entities: DataFrame, reflections: DataFrame) -> DataFrame:
    """One row: episodes, active_notes, superseded_notes, entities, reflections, and recent: the ten entities seen last (name, kind, lastSeenAt), equal ones by name. All entities are counted."""
    n = notes.agg(F.count_if(F.col("superseded_at").isNull()).alias("active_notes"), F.count("superseded_at").alias("superseded_notes"))
    counted = lambda df, name: F.broadcast(df.agg(F.count("*").alias(name)))  # noqa: E731  one row
    top = entities.orderBy(F.desc("last_seen_at"), "name", "entity_id").limit(RECENT)
    key = F.struct(F.col("last_seen_at").isNull().alias("never"), (-F.unix_micros("last_seen_at")).alias("t"), "name", "entity_id", "kind", F.col("last_seen_at").alias("at"))
    recent = top.agg(F.transform(F.array_sort(F.collect_list(key)), lambda r: F.struct(r["name"].alias("name"), r["kind"].alias("kind"), r["at"].alias("lastSeenAt"))).alias("recent"))
    joined = n.join(counted(episodes, "episodes")).join(counted(entities, "entities")).join(counted(reflections, "reflections")).join(F.broadcast(recent))
    return joined.select("episodes", "active_notes", "superseded_notes", "entities", "reflections", "recent")


def bounded_count(df: DataFrame, most: int) -> DataFrame:
    """One row (n): how many rows a list of at most so many would show."""
    return df.limit(most).agg(F.count("*").alias("n"))
