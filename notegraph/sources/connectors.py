"""Batch connectors: markdown folders, webhooks, evaluation queries, backups and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegraph.functions.scalars import body, file_name, frontmatter, hmac_sha256, kind_name, markdown
from notegraph.sources.files import TextFiles

SLACK = "struct<type:string,challenge:string,event:struct<type:string,text:string,channel:string,user:string>>"
REPLAY_SECONDS = 300


def markdown_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every *.md under path, or those of a list of paths, whole: path, file, modified_at, text. Any store that Spark reads."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("modificationTime").alias("modified_at"), F.decode("content", "utf-8").alias("text"))


def markdown_episodes(files: DataFrame, label: str = "md-import") -> DataFrame:
    """One episode a file: source, content, header, metadata, status (ok, or skipped for a blank body)."""
    text = body(F.col("text"))
    return files.select(
        "path", F.concat(F.lit(f"{label}:"), "file").alias("source"), text.alias("content"), frontmatter(F.col("text")).alias("header"),
        F.create_map(F.lit("watcher_path"), F.col("path")).alias("metadata"), F.when(text == "", "skipped").otherwise("ok").alias("status"),
    )


def generic_webhook(requests: DataFrame) -> DataFrame:
    """requests (name, body): content is the JSON object's own string content, else the raw body; status 400 for a blank or too long name or a blank body. Where content was taken, the raw body stays as metadata, which is null elsewhere."""
    held = F.try_variant_get(F.try_parse_json("body"), "$.content", "variant")
    is_text = F.coalesce(F.schema_of_variant(held) == "STRING", F.lit(False))
    content = F.when(is_text, F.try_variant_get(held, "$", "string")).otherwise(F.col("body"))
    blank = lambda c: ~F.coalesce(F.col(c), F.lit("")).rlike(r"(?U)\S")
    bad = blank("name") | blank("body") | (F.char_length("name") > 64)
    metadata = F.when(is_text, F.create_map(F.lit("webhook_raw"), F.col("body")))
    return requests.select("*", content.alias("content"), F.concat(F.lit("webhook:"), "name").alias("source"), F.when(bad, 400).otherwise(200).alias("status"), metadata.alias("metadata"))


def slack_events(requests: DataFrame) -> DataFrame:
    """requests (body) parsed: action is challenge, ingest (a message or mention with text) or ignore."""
    x = F.from_json("body", SLACK)
    parsed = requests.withColumn("x", x)
    keep = (F.col("x.type") == "event_callback") & F.col("x.event.type").isin("message", "app_mention") & (F.trim(F.coalesce("x.event.text", F.lit(""))) != "")
    action = F.when(F.col("x.type") == "url_verification", "challenge").when(F.coalesce(keep, F.lit(False)), "ingest").otherwise("ignore")
    return parsed.select(*requests.columns, action.alias("action"), F.col("x.challenge").alias("challenge"), F.col("x.event.text").alias("content"), F.create_map(F.lit("channel"), F.col("x.event.channel"), F.lit("user"), F.col("x.event.user")).alias("metadata"))


def slack_signed(secret: Column, timestamp: Column, raw: Column, signature: Column, now: Column) -> Column:
    """Whether a request of the last five minutes carries the right signature."""
    made = F.concat(F.lit("v0="), hmac_sha256(secret, F.concat(F.lit("v0:"), timestamp.cast("string"), F.lit(":"), raw)))
    return (F.abs(now.cast("long") - timestamp.cast("long")) <= REPLAY_SECONDS) & (made == signature)


def eval_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, gold_id, query) of an evaluation document."""
    found = spark.read.schema("queries array<struct<noteId:string,query:string>>, topK int").json(path, multiLine=True)
    return found.select(F.posexplode("queries").alias("query_id", "q"), "topK").select("query_id", F.col("q.noteId").alias("gold_id"), "q.query", "topK")


def export_markdown(notes: DataFrame, path: str) -> None:
    """Each note as a file of its own under path, which executors must reach; markdown_files() reads them back. A note of an earlier export is replaced. Notes whose names would be alike get their whole id's hash at the end."""
    notes.sparkSession.dataSource.register(TextFiles)
    made = rendered_notes(notes)
    alike = made.groupBy("file").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("file").alias("f"), F.lit(True).alias("shared"))
    own = F.concat(F.regexp_replace("file", r"\.md$", "_"), F.md5("note_id"), F.lit(".md"))
    named = made.join(alike, F.col("file") == F.col("f"), "left").select(F.when(F.col("shared"), own).otherwise(F.col("file")).alias("file"), F.coalesce("text", F.lit("")).alias("text"))
    named.write.format("text_files").mode("append").option("path", path).save()


def rendered_notes(notes: DataFrame) -> DataFrame:
    """(note_id, file, text) of each note."""
    kind = kind_name(F.col("kind"))
    note_id = F.col("note_id").cast("string")
    return notes.select("note_id", file_name(F.col("created_at"), kind, F.col("content"), note_id).alias("file"), markdown(note_id, kind, F.col("created_at"), F.col("tags"), F.col("keywords"), F.col("context"), F.col("content")).alias("text"))


def backup(relations: dict[str, DataFrame], path: str, *, embeddings: bool = False) -> DataFrame:
    """Writes each relation as JSON lines under path, without embeddings unless asked, and returns the manifest (relation, rows, active)."""
    spark = next(iter(relations.values())).sparkSession
    rows = []
    for name, df in relations.items():
        if name.endswith("embeddings") and not embeddings:
            continue
        df.write.mode("overwrite").json(f"{path}/{name}")
        gone = next((c for c in ("superseded_at", "invalidated_at") if c in df.columns), None)
        n, active = df.agg(F.count("*"), F.count_if(F.col(gone).isNull()) if gone else F.count("*")).first()
        rows.append((name, n, active))
    manifest = spark.createDataFrame(rows, T.StructType([T.StructField("relation", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("active", T.LongType())]))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def restore(spark: SparkSession, path: str, name: str, old: DataFrame, keys: list[str]) -> DataFrame:
    """old with those rows of a backup's relation whose keys it lacks."""
    from notegraph.operators.mutations import insert_absent

    return insert_absent(old, spark.read.schema(old.schema).json(f"{path}/{name}"), keys)
