"""Episodes as the service's write calls take them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.functions import defaults

IMAGES = "array<struct<data:string,mimeType:string,caption:string>>"
DEFAULT_SOURCE, DEFAULT_MIME = "api", "image/png"
PREVIEW, EVAL_NOTES, MOST_EVAL_NOTES = 120, 30, 200


def _blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(r"(?U)\S")


def _or(c: Column, default: str) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(default)).otherwise(c)


def api_episodes(requests: DataFrame, describe: Callable[[Column, Column], Column] = defaults.caption) -> DataFrame:
    """requests with source, content, n_images and status: 400 without content and images.

    Each image whose data is base64 is described by its bytes and type, and that text stands before the content, under
    its own caption or type; images that are no base64, or whose description is null or blank, are left out.
    """
    shown = F.transform("images", lambda i: F.struct(F.try_to_binary(i["data"], F.lit("base64")).alias("bytes"), _or(i["mimeType"], DEFAULT_MIME).alias("mime"), i["caption"].alias("title"), i["data"].alias("data")))
    read = F.filter(shown, lambda i: i["bytes"].isNotNull() & (i["data"] != ""))
    told = F.transform(read, lambda i: F.struct(i["mime"].alias("mime"), i["title"].alias("title"), describe(i["bytes"], i["mime"]).alias("told")))
    kept = F.coalesce(F.filter(told, lambda i: ~_blank(i["told"])), F.array().cast("array<struct<mime:string,title:string,told:string>>"))
    block = lambda i: F.concat(F.lit("[image: "), F.when(F.coalesce(i["title"], F.lit("")) == "", i["mime"]).otherwise(i["title"]), F.lit("]\n"), i["told"], F.lit("\n\n"))
    images = requests.withColumn("_kept", kept)
    lead, text = F.array_join(F.transform("_kept", block), ""), F.coalesce("content", F.lit(""))
    whole = F.when(F.size("_kept") == 0, text).otherwise(F.concat(lead, F.when(text == "", "").otherwise(F.concat(F.lit("\n"), text))))
    status = F.when(_blank(F.col("content")) & (F.coalesce(F.size("images"), F.lit(0)) <= 0), 400).otherwise(200)
    return images.withColumn("status", status).withColumn("content", whole).withColumn("n_images", F.size("_kept")).withColumn("source", F.coalesce("source", F.lit(DEFAULT_SOURCE))).drop("_kept")


def save_episodes(requests: DataFrame) -> DataFrame:
    """requests (source, content, occurred_at as text) with occurred_at as a time; null where the text is none."""
    return requests.withColumn("occurred_at", F.try_to_timestamp(F.col("occurred_at")))


def eval_requests(notes: DataFrame, count: int = EVAL_NOTES, ask: Callable[[Column], Column] = defaults.question) -> DataFrame:
    """(note_id, query, preview) of the newest active notes, 1 to 200 of them: a question each, without white space and quotes around it; notes without one drop."""
    top = notes.filter("superseded_at is null").orderBy(F.desc("created_at"), F.desc("note_id")).limit(max(1, min(count, MOST_EVAL_NOTES)))
    query = F.btrim(F.trim(ask(F.col("content"))), F.lit('"'))
    return top.select("note_id", query.alias("query"), F.substring("content", 1, PREVIEW).alias("preview")).filter(F.col("query") != "")
