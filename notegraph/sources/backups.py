"""Backups of a project, dumps of a tenant, and their restore. Collections are folders of gzipped JSON lines; the manifest is written last."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from notegraph.operators.mutations import insert_absent
from notegraph.schemas import BY_PROJECT, RELATIONS
from notegraph.sources.connectors import rendered_notes

# Collections of a backup, in order, and the relations that a restore takes, with their keys.
COLLECTIONS = ("episodes", "notes", "note_embeddings", "note_entity_mentions", "note_relations", "reflections", "image_embeddings", "entities", "edges")
RESTORED = {"organizations": ["id"], "users": ["id"], "memberships": ["organization_id", "user_id"], "projects": ["id"]}
ASCENDING = {"episodes": "ingested_at", "notes": "created_at", "reflections": "generated_at"}
MANIFEST = "relation string, rows long, active long"
#: Fast rather than small: most of what gzip saves comes at its first level.
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def _written(df: DataFrame, path: str) -> tuple[int, int]:
    """Rows and active rows of df, counted while it is written."""
    gone = next((c for c in ("superseded_at", "invalidated_at") if c in df.columns), None)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(gone).isNull() if gone else F.lit(True)).alias("active")).write.mode("overwrite").options(**GZIP).json(path)
    return seen.get["rows"], seen.get["active"]


def _manifest(spark: SparkSession, rows: list, path: str) -> DataFrame:
    made = spark.createDataFrame(rows, MANIFEST)
    made.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return made


def backup(relations: dict[str, DataFrame], path: str, *, note_embeddings: bool = True, image_embeddings: bool = True) -> DataFrame:
    """Writes a project's collections, oldest rows first where they have a time, and its active notes as markdown rows; returns the manifest (relation, rows, active). Embeddings are left out on demand, image embeddings also where there are none."""
    spark, rows = next(iter(relations.values())).sparkSession, []
    left_out = set() if note_embeddings else {"note_embeddings"}
    left_out |= set() if image_embeddings and not relations["image_embeddings"].isEmpty() else {"image_embeddings"}
    for name in COLLECTIONS:
        if name not in left_out:
            df = relations[name]
            rows.append((name, *_written(df.orderBy(ASCENDING[name]) if name in ASCENDING else df, f"{path}/{name}")))
    active = rendered_notes(relations["notes"].filter("superseded_at is null"))
    rows.append(("notes-md", *_written(active, f"{path}/notes-md")))
    return _manifest(spark, rows, path)


def tenant(relations: dict[str, DataFrame], organization_id) -> dict[str, DataFrame]:
    """The relations' rows of one organization: its own, its members' and its projects'."""
    own = relations["memberships"].filter(F.col("organization_id") == organization_id)
    projects = relations["projects"].filter(F.col("organization_id") == organization_id)
    ids = projects.select(F.col("id").alias("project_id"))
    found = {
        "organizations": relations["organizations"].filter(F.col("id") == organization_id),
        "users": relations["users"].join(own.select(F.col("user_id").alias("id")), "id", "left_semi"),
        "memberships": own,
        "projects": projects,
    }
    return found | {name: relations[name].join(ids, "project_id", "left_semi") for name in BY_PROJECT if name in relations and name != "api_keys"}


def dump(relations: dict[str, DataFrame], organization_id, path: str) -> DataFrame:
    """Writes tenant() under path and returns its tallies (relation, rows, active)."""
    spark = relations["organizations"].sparkSession
    return _manifest(spark, [(name, *_written(df, f"{path}/{name}")) for name, df in tenant(relations, organization_id).items()], path)


def restore(spark: SparkSession, path: str, old: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(old with a dump's organizations, users, memberships and projects that it lacks, tallies (relation, rows, active): rows in the dump and of those the new ones)."""
    made, tallies = {}, []
    for name, keys in RESTORED.items():
        new = spark.read.schema(old[name].schema).json(f"{path}/{name}")
        made[name] = insert_absent(old[name], new, keys)
        tallies.append((name, new.count(), new.dropDuplicates(keys).join(old[name].select(*keys), keys, "left_anti").count()))
    return made, spark.createDataFrame(tallies, MANIFEST)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], RELATIONS[name])
