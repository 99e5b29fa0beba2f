"""Tenants, API keys and the registry of tenant schemas, as appends and keyed updates of relations."""

from __future__ import annotations

import re
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.functions.scalars import key_hash, tenant_slug
from notegraph.operators.mutations import insert_absent
from notegraph.schemas import MEMBER_ROLES, RELATIONS

# The prefix of a token, and states of a tenant schema, by code.
TOKEN_PREFIX = "memk_"
STATUS = ("provisioned", "active", "deactivated")
ACTIVE = STATUS.index("active")


def derived_id(*parts: Column) -> Column:
    """A UUID-shaped id of the parts, so that a repeated run names the same rows."""
    h = F.md5(F.concat_ws("\t", *parts))
    return F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def bootstrap(requests: DataFrame, now: str) -> dict[str, DataFrame]:
    """Rows of organizations, users, memberships (owners) and projects for requests (org_name, user_email, user_name, project_name, embedding_model). Ids follow from slugs and addresses."""
    at = F.lit(now).cast("timestamp")
    org, user = tenant_slug(F.col("org_name")), F.col("user_email")
    made = requests.select(
        "*", at.alias("now"), org.alias("org_slug"), tenant_slug(F.col("project_name")).alias("project_slug"), derived_id(F.lit("organization"), org).alias("org_id"), derived_id(F.lit("user"), user).alias("user_id"),
    )
    of = lambda **c: made.select(*(F.col(v).alias(k) for k, v in c.items())).distinct()
    owner = F.lit(MEMBER_ROLES.index("Owner")).cast("short")
    projects = of(organization_id="org_id", slug="project_slug", name="project_name", embedding_model="embedding_model", created_at="now")
    return {
        "organizations": of(id="org_id", slug="org_slug", name="org_name", created_at="now").dropDuplicates(["slug"]),
        "users": of(id="user_id", email="user_email", display_name="user_name", created_at="now").dropDuplicates(["email"]),
        "memberships": of(organization_id="org_id", user_id="user_id", granted_at="now").withColumn("role", owner).select(*RELATIONS["memberships"].names),
        "projects": projects.dropDuplicates(["organization_id", "slug"]).select(derived_id(F.lit("project"), F.col("organization_id"), F.col("slug")).alias("id"), "*"),
    }


def token(raw: Column) -> Column:
    """The token of 32 bytes: the prefix and their URL-safe base64 without padding."""
    return F.concat(F.lit(TOKEN_PREFIX), F.rtrim(F.translate(F.base64(raw), "+/=", "-_ ")))


def new_token() -> str:
    """A token of 32 random bytes, made on the driver: one that a plan made would change when the plan runs again. Only its hash is kept."""
    return TOKEN_PREFIX + secrets.token_urlsafe(32)


def key_rows(requests: DataFrame, now: str) -> DataFrame:
    """Rows of api_keys for requests (id, token, organization_id, project_id, created_by_user_id, name, is_admin); a missing name is unnamed."""
    none, at = F.lit(None).cast("timestamp"), F.lit(now).cast("timestamp")
    name, admin = F.coalesce("name", F.lit("unnamed")), F.coalesce("is_admin", F.lit(False))
    return requests.select(
        "id", key_hash(F.col("token")).alias("key_hash"), "organization_id", "project_id", "created_by_user_id", name.alias("name"), at.alias("created_at"), none.alias("last_used_at"), none.alias("revoked_at"), admin.alias("is_admin"),
    )


def key_list(keys: DataFrame) -> DataFrame:
    """Keys without their hashes, newest first, with their role and whether they are live."""
    role = F.when(F.col("is_admin"), "admin").otherwise("tenant")
    return keys.select("id", "name", "organization_id", "project_id", "created_at", "last_used_at", "revoked_at", role.alias("role"), F.col("revoked_at").isNull().alias("live")).orderBy(F.desc("created_at"), "id")


def touch(keys: DataFrame, uses: DataFrame) -> DataFrame:
    """keys with last_used_at moved to the last of their uses (key_hash, used_at); an earlier use moves nothing."""
    last = uses.groupBy(F.col("key_hash").alias("_h")).agg(F.max("used_at").alias("_at"))
    return keys.join(last, F.col("key_hash") == F.col("_h"), "left").withColumn("last_used_at", F.greatest("last_used_at", "_at")).drop("_h", "_at")


def schema_name(organization_id: Column) -> Column:
    """org_ and the first twelve hex digits of the id."""
    return F.concat(F.lit("org_"), F.substring(F.replace(organization_id, F.lit("-"), F.lit("")), 1, 12))


def provision(registry: DataFrame, organizations: DataFrame, now: str) -> DataFrame:
    """registry with a provisioned schema for each organization (id) that it lacks."""
    new = organizations.select(
        F.col("id").alias("organization_id"), schema_name(F.col("id")).alias("schema_name"), F.lit(0).cast("short").alias("status"), F.lit(now).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("activated_at"),
    )
    return insert_absent(registry, new, ["organization_id"])


def schema_list(registry: DataFrame) -> DataFrame:
    """The registry, newest first, with states by name; an unknown code stands in ?()."""
    name = F.coalesce(F.get(F.array(*map(F.lit, STATUS)), F.col("status").cast("int")), F.concat(F.lit("?("), F.col("status").cast("string"), F.lit(")")))
    return registry.select("organization_id", "schema_name", name.alias("status"), "created_at", "activated_at").orderBy(F.desc("created_at"), "organization_id")


def drop_schemas(registry: DataFrame, organizations: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(registry without the organizations' (id) schemas, those refused): an active schema goes only by force."""
    asked = registry.join(organizations.select(F.col("id").alias("organization_id")).distinct(), "organization_id", "left_semi")
    refused = asked.filter(F.lit(not force) & (F.col("status") == ACTIVE))
    gone = asked.join(refused.select("organization_id"), "organization_id", "left_anti")
    return registry.join(gone.select("organization_id"), "organization_id", "left_anti"), refused


def create_database(spark: SparkSession, name: str, *, drop: bool = False) -> None:
    """Makes, or drops with all it holds, the database of a schema name; other names raise."""
    if not re.fullmatch(r"org_[0-9a-f]{12}", name):
        raise ValueError(f"not the name of a tenant schema: {name!r}")
    spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE" if drop else f"CREATE DATABASE IF NOT EXISTS `{name}`")
