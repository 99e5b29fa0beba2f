"""The driver's tables as relations of the memory model, with ids of their own types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.storage import sized, stored

EPOCH = "2024-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes, without supersession: no shuffle."""
    d = read(spark, sf_dir, "documents")
    created = F.timestamp_add("HOUR", F.col("doc_id").cast("int"), F.to_timestamp(F.lit(EPOCH)))
    return d.select(
        F.col("doc_id").alias("note_id"), F.col("source").alias("project_id"), F.col("text").alias("content"), F.col("lang").alias("context"),
        F.array("lang", "source").alias("tags"), F.array("lang").alias("keywords"), (F.col("doc_id") % 6).cast("int").alias("kind"), created.alias("created_at"),
    )


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, a minute apart, conversations an hour."""
    minutes = (F.col("conv_id") * 60 + F.col("turn")).cast("int")
    at = F.timestamp_add("MINUTE", minutes, F.to_timestamp(F.lit(EPOCH)))
    return read(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("episode_id"), F.col("role").alias("source"), F.col("text").alias("content"), at.alias("ingested_at"))


def superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """note_id of every note whose content an earlier note has. Texts are hashed before they move."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("h"), F.char_length("text").alias("n"))
    first = d.groupBy("h", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).filter("c > 1")
    return d.join(first, ["h", "n"]).filter("doc_id > first").select(F.col("doc_id").alias("note_id"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with superseded_at: a day after the creation of each later copy. The copies' ids are found once and, if they are few enough, broadcast, so that texts don't move."""
    gone = stored(superseded(spark, sf_dir), "superseded").withColumn("gone", F.lit(True))
    return raw_notes(spark, sf_dir).join(sized(gone), "note_id", "left").withColumn("superseded_at", F.when(F.col("gone"), F.col("created_at") + F.expr("interval 1 day"))).drop("gone")


def note_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("note_id"), "embedding")


def image_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several images a note: vectors dealt to a hundred notes."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), (F.col("vec_id") % 100).alias("note_id"), "embedding")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, parts, nations and regions; ids carry the kind's letter."""
    parts = (("supplier", "s", "s_suppkey", "s_name"), ("part", "p", "p_partkey", "p_name"), ("nation", "n", "n_nationkey", "n_name"), ("region", "r", "r_regionkey", "r_name"))
    made = [read(spark, sf_dir, t).select(F.concat(F.lit(f"{c}:"), F.col(k).cast("string")).alias("entity_id"), F.col(n).alias("name"), F.lit(t).alias("kind")) for t, c, k, n in parts]
    return made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier SUPPLIES part (valid from the first shipment; invalidated at the last when every line was returned), supplier IN nation, nation IN region."""
    li = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(
        F.min("l_shipdate").alias("valid_from"), F.when(F.min((F.col("l_returnflag") == "R").cast("int")) == 1, F.max("l_shipdate")).alias("invalidated_at")
    )
    name = lambda c, k: F.concat(F.lit(f"{c}:"), F.col(k).cast("string"))
    none = F.lit(None).cast("timestamp")
    stamp = lambda c: F.col(c).cast("timestamp")
    supplies = li.select(name("s", "l_suppkey").alias("from_id"), name("p", "l_partkey").alias("to_id"), F.lit("SUPPLIES").alias("relation"), stamp("valid_from").alias("valid_from"), none.alias("valid_to"), stamp("invalidated_at").alias("invalidated_at"))
    of = lambda t, c, k, d, f: read(spark, sf_dir, t).select(name(c, k).alias("from_id"), name(d, f).alias("to_id"), F.lit("IN").alias("relation"), none.alias("valid_from"), none.alias("valid_to"), none.alias("invalidated_at"))
    return supplies.unionByName(of("supplier", "s", "s_suppkey", "n", "s_nationkey")).unionByName(of("nation", "n", "n_nationkey", "r", "n_regionkey"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each note mentions the supplier and the part of its id, modulo a hundred and a thousand."""
    d = read(spark, sf_dir, "documents").select("doc_id")
    of = lambda c, n: d.select(F.col("doc_id").alias("note_id"), F.concat(F.lit(f"{c}:"), (F.col("doc_id") % n).cast("string")).alias("entity_id"))
    return of("s", 100).unionByName(of("p", 1000))


def reflections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One a day and project of events, whose scopes alternate."""
    e = read(spark, sf_dir, "events")
    day = F.to_date("ts")
    made = e.groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    scope = F.when(F.dayofmonth("day") % 2 == 0, F.lit("daily")).otherwise(F.lit("meta"))
    return made.select(F.date_format("day", "yyyyMMdd").cast("long").alias("reflection_id"), scope.alias("scope"), F.concat(F.lit("events "), F.col("n").cast("string")).alias("summary"), F.to_timestamp("day").alias("generated_at"))
