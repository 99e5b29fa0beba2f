"""Structured Streaming: watched folders, webhook events, windows, sessions and idempotent delivery."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from notegraph.functions.defaults import extraction
from notegraph.plans.ingest import store
from notegraph.sources.connectors import generic_webhook, markdown_episodes, markdown_files
from notegraph.storage import committed, next_batch

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


SEEN = T.StructType([T.StructField("path", T.StringType()), T.StructField("modified_at", T.TimestampType()), T.StructField("poll", T.LongType())])
#: Files that one poll takes; the others come with the next.
MOST_FILES = 10_000


def due_files(spark: SparkSession, folder: str, root: str, most: int = MOST_FILES) -> list[str]:
    """Paths of *.md files under folder whose time differs from the one at which they were last taken in, the oldest first. Only the listing is read, no file."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(folder).select("path", F.col("modificationTime").alias("modified_at"))
    seen = committed(spark, root, "seen_files", SEEN).groupBy("path").agg(F.max_by("modified_at", "poll").alias("seen_at"))
    due = found.join(seen, "path", "left").filter(~F.col("modified_at").eqNullSafe(F.col("seen_at")))
    return [r["path"] for r in due.orderBy("modified_at", "path").limit(most).collect()]


def poll_markdown(spark: SparkSession, folder: str, root: str, project_id: str, now: str, *, extract: Callable[[Column], Column] = extraction, gate: Callable[[DataFrame], DataFrame] | None = None, most: int = MOST_FILES, **options) -> int | None:
    """Takes in the new and changed files of a watched folder as one batch of the memory under root; its number, or None where none is due.

    A file whose time differs from the last one it was taken in at is due, older or newer. Files taken in, left out by the gate, or without a body are recorded
    with the batch, whole or not at all; one whose extraction fails is not recorded and comes again. extract makes the extraction's JSON of a body; gate judges
    episodes (episode_id, save, score). An empty or missing folder has none due.
    """
    try:
        due = due_files(spark, folder, root, most)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if not due:
        return None
    files = markdown_files(spark, due)
    read = markdown_episodes(files, "md-watcher").join(files.select("path", "modified_at"), "path")
    told = read.select(
        F.md5(F.concat_ws("\t", "path", F.col("modified_at").cast("double").cast("string"))).alias("episode_id"), F.lit(project_id).alias("project_id"), "source", "content", "metadata",
        F.lit(now).cast("timestamp").alias("ingested_at"), "path", "modified_at", (F.col("status") == "ok").alias("has_body"), F.when(F.col("status") == "ok", extract(F.col("content"))).alias("extraction"),
    )
    number = next_batch(spark, root)
    taken = lambda rows: {"seen_files": rows.filter("ok or not keep or not has_body").select("path", "modified_at", F.lit(number).cast("long").alias("poll"))}
    return store(spark, root, told, now, judgments=gate(told) if gate else None, also=taken, **options)


def watching(spark: SparkSession, poll: Callable[[], object], checkpoint: str, every: str = "30 seconds") -> StreamingQuery:
    """Polls again and again, as a streaming query that can be stopped; what has been taken in is known from the memory's own commits."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda rows, i: poll()).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def webhook_stream(spark: SparkSession, path: str) -> DataFrame:
    """Requests dropped as JSON files (delivery_id, at, project_id, name, body), parsed; bad ones are filtered."""
    return generic_webhook(spark.readStream.schema("delivery_id string, at timestamp, project_id string, name string, body string").json(path)).filter("status = 200")


def take_in(requests: DataFrame, root: str, checkpoint: str, *, writer: str, now: str, extract: Callable[[Column], Column] = extraction, late: str = "1 hour", **options) -> StreamingQuery:
    """Ingests a stream of webhook requests into the memory under root, each delivery once.

    A delivery that comes again within the watermark drops in the stream's state. A micro-batch is committed under the stream's name and its own number, so one that
    broke off anywhere, even between staging and commit, is staged again and counts once; one that is there already is passed over.
    """

    def handle(rows: DataFrame, epoch: int) -> None:
        told = rows.select(F.col("delivery_id").alias("episode_id"), "project_id", "source", "content", "metadata", F.col("at").alias("ingested_at"), extract(F.col("content")).alias("extraction"))
        store(rows.sparkSession, root, told, now, writer=writer, epoch=epoch, **options)

    return deliver(once(requests.withColumn("ts", F.col("at")), "delivery_id", late), handle, checkpoint)


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events of Parquet files whose ts has no zone; watermarks need one."""
    raw = spark.readStream.schema(EVENTS.replace("ts timestamp", "ts timestamp_ntz")).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "6 hours", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark drop."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each key once, however often it is delivered within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def deliver(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs handle on each micro-batch of what is there now; after a failure the checkpoint repeats the batch with its number."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scheduled(tenants: list, run: Callable[[object], object]) -> dict:
    """Runs a job for each tenant in turn; one's failure doesn't stop the others."""
    done = {}
    for t in tenants:
        try:
            done[t] = run(t)
        except Exception as e:
            done[t] = e
    return done
