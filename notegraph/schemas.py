"""Schemas of the memory model's relations."""

from pyspark.sql import types as T

# Kinds of a note and roles of a member, by code.
NOTE_KINDS = ("General", "Observation", "Decision", "Learning", "Error", "Pattern")
MEMBER_ROLES = ("Owner", "Admin", "Member", "Viewer")

_s, _t, _i, _d, _b, _short = T.StringType(), T.TimestampType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.ShortType()
_map, _list, _vector = T.MapType(T.StringType(), T.StringType()), T.ArrayType(T.StringType()), T.ArrayType(T.FloatType(), False)


def _schema(**columns: T.DataType) -> T.StructType:
    """A trailing underscore marks a nullable column."""
    return T.StructType([T.StructField(k.rstrip("_"), v, k.endswith("_")) for k, v in columns.items()])


RELATIONS = {
    "organizations": _schema(id=_s, slug=_s, name=_s, created_at=_t),
    "users": _schema(id=_s, email=_s, display_name=_s, created_at=_t),
    "memberships": _schema(organization_id=_s, user_id=_s, role=_short, granted_at=_t),
    "projects": _schema(id=_s, organization_id=_s, slug=_s, name=_s, embedding_model=_s, created_at=_t),
    "episodes": _schema(id=_s, project_id=_s, source=_s, content=_s, occurred_at_=_t, ingested_at=_t, metadata=_map),
    "notes": _schema(id=_s, project_id=_s, source_episode_id_=_s, content=_s, context_description=_s, keywords=_list, tags=_list, kind=_short, created_at=_t, superseded_at_=_t),
    "note_embeddings": _schema(note_id=_s, project_id=_s, embedding_model=_s, dimensions=_i, embedding=_vector, created_at=_t),
    "image_embeddings": _schema(id=_s, note_id=_s, project_id=_s, model_id=_s, dimensions=_i, embedding=_vector, created_at=_t),
    "note_entity_mentions": _schema(note_id=_s, entity_id=_s, project_id=_s, created_at=_t),
    "note_relations": _schema(note_id=_s, related_note_id=_s, project_id=_s, relation_type=_s, confidence=_d, similarity=_d, description_=_s, created_at=_t),
    "reflections": _schema(id=_s, project_id=_s, scope=_s, summary=_s, generated_at=_t, generator_model=_s),
    "tenant_schemas": _schema(organization_id=_s, schema_name=_s, status=_short, created_at=_t, activated_at_=_t),
    "api_keys": _schema(id=_s, key_hash=_s, organization_id=_s, project_id=_s, created_by_user_id=_s, name=_s, created_at=_t, last_used_at_=_t, revoked_at_=_t, is_admin=_b),
    "entities": _schema(id=_s, project_id=_s, name=_s, kind=_s, attributes=_map, first_seen_at=_t, last_seen_at=_t),
    "edges": _schema(id=_s, project_id=_s, from_id=_s, to_id=_s, relation=_s, recorded_at=_t, valid_from_=_t, valid_to_=_t, invalidated_at_=_t, source_episode_=_s, properties=_map),
}
#: Relations as ingestion writes them and search, linking and views read them.
MEMORY = {
    "notes": _schema(note_id=_s, episode_id=_s, project_id=_s, content=_s, context_=_s, keywords_=_list, tags_=_list, kind=_short, created_at=_t),
    "note_embeddings": RELATIONS["note_embeddings"],
    "note_entity_mentions": RELATIONS["note_entity_mentions"],
    "entities": _schema(project_id=_s, name=_s, entity_id=_s, kind=_s, attributes_=_map, first_seen_at=_t, last_seen_at=_t),
    "edges": _schema(project_id=_s, from_id=_s, to_id=_s, relation=_s, edge_id=_s, recorded_at=_t, valid_from_=_t, valid_to_=_t, invalidated_at_=_t, source_episode_=_s, properties_=_map),
    "note_relations": _schema(source_id=_s, target_id=_s, project_id=_s, relation_type=_s, confidence=_d, created_at=_t),
    "reflections": RELATIONS["reflections"],
    "reflection_runs": _schema(project_id=_s, scope=_s, status=_s, n=T.LongType(), error_=_s, generated_at=_t),
    "supersessions": _schema(note_id=_s, project_id=_s, superseded_at=_t),
}
#: The stored text index: postings and terms' counts live in buckets of their terms; each batch adds to all three. times, length and words count contents alone.
INDEX = {
    "postings": _schema(term=_s, note_id=_s, project_id_=_s, score=_d, places=T.ArrayType(T.StructType([T.StructField("at", _i), T.StructField("weight", _d)])), times=_i, length=_i),
    "terms": _schema(term=_s, project_id_=_s, notes=T.LongType()),
    "text_totals": _schema(project_id_=_s, notes=T.LongType(), words=T.LongType(), buckets=_i),
}
#: (relation, column, relation that it refers to, what becomes of a row whose parent goes). Entities and edges go with their project, so that none of theirs is left.
CASCADE, SET_NULL, RESTRICT = "cascade", "set null", "restrict"
FOREIGN_KEYS = (
    ("memberships", "organization_id", "organizations", CASCADE), ("memberships", "user_id", "users", CASCADE), ("projects", "organization_id", "organizations", CASCADE),
    ("tenant_schemas", "organization_id", "organizations", CASCADE), ("api_keys", "organization_id", "organizations", CASCADE), ("api_keys", "project_id", "projects", CASCADE),
    ("episodes", "project_id", "projects", CASCADE), ("notes", "project_id", "projects", CASCADE), ("notes", "source_episode_id", "episodes", SET_NULL), ("reflections", "project_id", "projects", CASCADE),
    ("note_embeddings", "note_id", "notes", CASCADE), ("image_embeddings", "note_id", "notes", CASCADE), ("note_entity_mentions", "note_id", "notes", CASCADE),
    ("note_relations", "note_id", "notes", CASCADE), ("note_relations", "related_note_id", "notes", CASCADE),
    *((r, "project_id", "projects", RESTRICT) for r in ("note_embeddings", "image_embeddings", "note_entity_mentions", "note_relations")),
    ("entities", "project_id", "projects", CASCADE), ("edges", "project_id", "projects", CASCADE),
    ("edges", "from_id", "entities", CASCADE), ("edges", "to_id", "entities", CASCADE), ("note_entity_mentions", "entity_id", "entities", CASCADE),
)
#: Relations whose rows belong to a project, and those that belong to an organization.
BY_PROJECT = tuple(k for k, v in RELATIONS.items() if "project_id" in v.names)
BY_ORGANIZATION = tuple(k for k, v in RELATIONS.items() if "organization_id" in v.names and "project_id" not in v.names)
UNIQUE = {"organizations": ("slug",), "users": ("email",), "projects": ("organization_id", "slug"), "tenant_schemas": ("schema_name",), "api_keys": ("key_hash",)}
