"""Linking, reflection, the importance gate, evaluation, dashboards and lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegraph.functions.scalars import kind_name, similarity
from notegraph.models import Summariser
from notegraph.operators.vector import knn
from notegraph.storage import stored

# Defaults of the linker, the gate, reflection windows and lists.
NEIGHBOURS, LEAST_SIMILAR, LEAST_CONFIDENT = 5, 0.30, 0.60
LEAST_IMPORTANT, MAX_NOTES = 0.30, 30
# The relation of a note to what it repeats, and how sure that must be for it to be superseded.
DUPLICATES, SURE = "duplicates", 0.90
# What stands over a reflection's sources, and the answers without any.
NOTE_HEADER = "Reflect on these {n} recent notes (most recent first):\n\n"
META_HEADER = "Synthesize across these {n} reflections (most recent first):\n\n"
NO_NOTES = "No notes found in the requested window — nothing to reflect on yet."
NO_REFLECTIONS = "No reflections found in the requested window — generate some lower-level reflections first."
#: Pieces of a text by which it meets the notes that may hold it.
ANCHOR = 5
LIMITS = {"episodes": (50, 500), "notes": (50, 500), "reflections": (20, 100), "edges": (50, 1000), "entities": (50, 200)}


def link(embeddings: DataFrame, notes: DataFrame, k: int = NEIGHBOURS, least: float = LEAST_SIMILAR, new: DataFrame | None = None, within: str | None = None) -> DataFrame:
    """(source_id, target_id, similarity): the k nearest active others of each of the new notes (note_id), and only then those alike enough. Without new, every active note is linked. within: a column of the embeddings that both must share."""
    active = stored(embeddings.join(notes.filter("superseded_at is null").select("note_id"), "note_id"), "active")  # read for both sides and their sizes
    sources = None if new is None else active.join(new.select("note_id").distinct(), "note_id", "left_semi")
    return knn(active, k, sources=sources, within=within).withColumn("similarity", similarity(F.col("distance"))).filter(F.col("similarity") >= least).drop("distance")


def judge(pairs: DataFrame, notes: DataFrame) -> DataFrame:
    """Judgments of pairs (source_id, target_id, similarity) without a model: equal contents are duplicates of confidence 1, others related-to, as sure as they are alike."""
    said = notes.select("note_id", F.sha2("content", 256).alias("h"))
    side = lambda c: said.select(F.col("note_id").alias(c), F.col("h").alias(f"{c}_h"))
    met = pairs.join(side("source_id"), "source_id").join(side("target_id"), "target_id")
    same = F.coalesce(F.col("source_id_h") == F.col("target_id_h"), F.lit(False))
    return met.select("source_id", "target_id", F.lit(True).alias("related"), F.when(same, "duplicates").otherwise("related-to").alias("relation_type"), F.when(same, 1.0).otherwise(F.col("similarity")).alias("confidence"))


def judged_links(pairs: DataFrame, judgments: DataFrame, existing: DataFrame) -> DataFrame:
    """Pairs (source_id, target_id) judged related with confidence enough, without those that exist; a blank type is related-to."""
    kept = pairs.join(judgments, ["source_id", "target_id"]).filter(F.col("related") & (F.col("confidence") >= LEAST_CONFIDENT))
    kind = F.when(F.trim(F.coalesce("relation_type", F.lit(""))) == "", "related-to").otherwise(F.col("relation_type"))
    return kept.withColumn("relation_type", kind).drop("related").join(existing.select("source_id", "target_id"), ["source_id", "target_id"], "left_anti")


def related_notes(relations: DataFrame, notes: DataFrame, note_id, n: int) -> DataFrame:
    """The note's n most confident relations and then their notes, superseded ones too; a relation without its note drops after the cut."""
    top = relations.filter(F.col("source_id") == note_id).orderBy(F.desc("confidence"), "target_id").limit(n)
    return notes.join(F.broadcast(top), F.col("note_id") == F.col("target_id"))


def gate(episodes: DataFrame, judgments: DataFrame, least: float = LEAST_IMPORTANT) -> DataFrame:
    """episodes with keep and skip_reason: kept if judged worth saving with score enough, or not judged at all."""
    j = judgments.select("episode_id", "save", F.col("score").alias("importance"))
    score = F.coalesce("importance", F.lit(1.0))
    keep = F.coalesce("save", F.lit(True)) & (score >= least)
    return episodes.join(j, "episode_id", "left").withColumn("importance", score).withColumn("keep", keep).withColumn("skip_reason", F.when(~keep, F.lit("not important enough"))).drop("save")


def reflection_window(notes: DataFrame, now: str, since: str | None = None, until: str | None = None, most: int = MAX_NOTES) -> DataFrame:
    """Active notes created from since (or a week before now) to until (or now), newest first."""
    end = F.lit(until or now).cast("timestamp")
    start = F.lit(since).cast("timestamp") if since else F.lit(now).cast("timestamp") - F.expr("interval 7 days")
    return notes.filter(F.col("superseded_at").isNull() & F.col("created_at").between(start, end)).orderBy(F.desc("created_at"), F.desc("note_id")).limit(most)


def is_meta(scope: str) -> bool:
    return scope.lower() == "meta" or scope.lower().startswith("meta:")


def meta_window(reflections: DataFrame, scope: str, now: str, most: int = MAX_NOTES, since: str | None = None, until: str | None = None) -> DataFrame:
    """Reflections of other scopes from since (or 90 days before now) to until (or now), newest first."""
    start = F.lit(since).cast("timestamp") if since else F.lit(now).cast("timestamp") - F.expr("interval 90 days")
    return reflections.filter((F.col("scope") != scope) & F.col("generated_at").between(start, F.lit(until or now).cast("timestamp"))).orderBy(F.desc("generated_at"), F.desc("reflection_id")).limit(most)


def _body() -> Column:
    """A bullet for each note of a group, newest first."""
    context = F.when(F.trim(F.coalesce("context", F.lit(""))) == "", "").otherwise(F.concat(F.lit("("), F.col("context"), F.lit(") ")))
    bullet = F.concat(F.lit("- ["), F.date_format("created_at", "yyyy-MM-dd"), F.lit("] "), context, F.coalesce("content", F.lit("")))
    rows = F.reverse(F.array_sort(F.collect_list(F.struct("created_at", "note_id", bullet.alias("line")))))
    return F.array_join(F.transform(rows, lambda r: r["line"]), "\n")


def reflection_body(notes: DataFrame) -> DataFrame:
    """One row (body, n): a bullet for each note of a window, newest first. No notes: an empty body."""
    return notes.agg(_body().alias("body"), F.count("*").alias("n"))


def meta_body(reflections: DataFrame) -> DataFrame:
    """One row (body, n): a block for each reflection of a window, newest first."""
    block = F.concat(F.lit("--- ["), F.date_format("generated_at", "yyyy-MM-dd"), F.lit("] scope="), F.col("scope"), F.lit(" ---\n"), F.coalesce("summary", F.lit("")), F.lit("\n"))
    rows = F.reverse(F.array_sort(F.collect_list(F.struct("generated_at", "reflection_id", block.alias("line")))))
    return reflections.agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("body"), F.count("*").alias("n"))


def reflect(notes: DataFrame, reflections: DataFrame, scope: str, now: str, writer: Summariser, *, since: str | None = None, until: str | None = None, most: int = MAX_NOTES) -> tuple[DataFrame, str, int]:
    """(new reflection (scope, summary, generated_at, generator_model), its summary, how many sources): written of a window's notes, or of other scopes' reflections if scope is meta. Without sources no row, and a message. The writer sees one text of at most so many sources."""
    meta = is_meta(scope)
    made = meta_body(meta_window(reflections, scope, now, most, since, until)) if meta else reflection_body(reflection_window(notes, now, since, until, most))
    body, n = made.first()
    summary = writer.summarise(scope, (META_HEADER if meta else NOTE_HEADER).format(n=n) + body) if n else NO_REFLECTIONS if meta else NO_NOTES
    rows = [(scope, summary, writer.name)] if n else []
    row = notes.sparkSession.createDataFrame(rows, "scope string, summary string, generator_model string")
    return row.select("scope", "summary", F.lit(now).cast("timestamp").alias("generated_at"), "generator_model"), summary, n


def reflect_all(projects: DataFrame, notes: DataFrame, scope: str, now: str, writer: Summariser, *, since: str | None = None, until: str | None = None, most: int = MAX_NOTES) -> DataFrame:
    """One row a project (project_id): status, n, summary, error, scope, generated_at, generator_model, in one plan for all.

    Each project's window is that of reflection_window(): its newest active notes, `most` at most, so that a body is bounded however many notes there are. The writer
    gets a body at a time in the tasks. status is written, empty (no notes in the window) or failed (the writer raised: error holds its words); one
    project's failure leaves the others be. Repeated and null projects count once and not at all.
    """
    end = F.lit(until or now).cast("timestamp")
    start = F.lit(since).cast("timestamp") if since else F.lit(now).cast("timestamp") - F.expr("interval 7 days")
    newest = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("note_id")))
    window = notes.filter(F.col("superseded_at").isNull() & F.col("created_at").between(start, end)).withColumn("place", newest).filter(F.col("place") <= most)
    bodies = window.groupBy("project_id").agg(_body().alias("body"), F.count("*").alias("n"))
    head, tail = NOTE_HEADER.split("{n}")
    asked = projects.filter("project_id is not null").select("project_id").distinct().join(bodies, "project_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))

    @F.pandas_udf("summary string, error string")
    def write(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            try:
                out.append((None if text is None else writer.summarise(scope, text), None))
            except Exception as e:
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["summary", "error"], dtype=object)

    told = asked.withColumn("w", write(F.when(F.col("n") > 0, F.concat(F.lit(head), F.col("n").cast("string"), F.lit(tail), F.col("body")))))
    status = F.when(F.col("n") == 0, "empty").when(F.col("w.error").isNotNull(), "failed").otherwise("written")
    return told.select("project_id", status.alias("status"), "n", F.col("w.summary").alias("summary"), F.col("w.error").alias("error"), F.lit(scope).alias("scope"), F.lit(now).cast("timestamp").alias("generated_at"), F.lit(writer.name).alias("generator_model"))


def related_entities(hits: DataFrame, mentions: DataFrame) -> DataFrame:
    """hits (a search's few) with related, the sorted ids of the entities that the note mentions; an empty list for none."""
    kind = mentions.schema["entity_id"].dataType
    own = mentions.join(F.broadcast(hits.select("note_id")), "note_id", "left_semi").groupBy("note_id").agg(F.sort_array(F.collect_set("entity_id")).alias("related"))
    return hits.join(own, "note_id", "left").withColumn("related", F.coalesce("related", F.array().cast(T.ArrayType(kind))))


def _windows(text: Column, width: int, inner: bool) -> Column:
    """Distinct hashes of width pieces in a row of a text cut at spaces; inner leaves out the first and the last piece, which may be parts of words."""
    rows = lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - width), lambda i: F.xxhash64(F.lit(width), *(F.get(p, i + k) for k in range(width))))
    found = lambda p: F.when(F.size(p) >= width, F.array_distinct(rows(p)))
    cut = F.split(text, " ", -1)
    return F.get(F.transform(F.array(F.slice(cut, 2, F.greatest(F.size(cut) - 2, F.lit(0))) if inner else cut), found), F.lit(0))  # cut once, as the lambda's variable


def contained(queries: DataFrame, notes: DataFrame) -> DataFrame:
    """(query_id, gold_id) of each query (query_id, text) whose text, if it has any, stands in a note's content.

    Pieces inside a text, cut at spaces, stand in a row in every note that holds it. So notes meet queries by the hash of ANCHOR such pieces (of one piece in
    texts of fewer than ANCHOR + 2), namely each query's rarest among the notes, and only those pairs are compared whole. Texts without a piece inside are
    compared with every note.
    """
    asked = queries.filter(F.length("text") > 0).select("query_id", "text").distinct()
    pieces = F.size(F.split("text", " ", -1))
    widths = {ANCHOR: pieces >= ANCHOR + 2, 1: (pieces > 2) & (pieces < ANCHOR + 2)}
    of = [asked.filter(fits).select("query_id", "text", F.explode(_windows(F.col("text"), w, True)).alias("h")) for w, fits in widths.items()]
    sought = stored(of[0].unionByName(of[1]), "sought")
    there = F.concat(*(F.coalesce(_windows(F.col("content"), w, False), F.array().cast("array<bigint>")) for w in widths))
    met = stored(notes.select("note_id", F.explode(there).alias("h")).join(sought.select("h").distinct(), "h", "left_semi").distinct(), "met")
    counted = sought.join(met.groupBy("h").agg(F.count("*").alias("n")), "h", "left")
    rarest = counted.groupBy("query_id", "text").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h")).alias("a")).filter("a.n > 0")
    near = rarest.select("query_id", "text", F.col("a.h").alias("h")).join(met, "h").join(notes.select("note_id", "content"), "note_id")
    short = asked.filter(pieces <= 2).join(notes.select("note_id", "content"), F.col("content").contains(F.col("text")))
    found = near.filter(F.col("content").contains(F.col("text")))
    return found.select("query_id", F.col("note_id").alias("gold_id")).unionByName(short.select("query_id", F.col("note_id").alias("gold_id")))


def gold_ranks(gold: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, gold_id, rank): the first position of the gold note among a query's hits (query_id, note_id, position), else -1."""
    met = gold.join(hits, (gold["query_id"] == hits["query_id"]) & (gold["gold_id"] == hits["note_id"]), "left")
    return met.groupBy(gold["query_id"], gold["gold_id"]).agg(F.coalesce(F.min("position"), F.lit(-1)).cast("int").alias("rank"))


def metrics(ranks: DataFrame, top_k: int = 10) -> DataFrame:
    """One row: queries, recall_1, 3, 5 and 10 (of min(10, top_k)), mrr, not_found; zeros without queries."""
    within = lambda k: F.round(F.coalesce(F.avg(F.when(F.col("rank").between(1, k), 1.0).otherwise(0.0)), F.lit(0.0)), 6)
    mrr = F.round(F.coalesce(F.avg(F.when(F.col("rank") >= 1, 1.0 / F.col("rank")).otherwise(0.0)), F.lit(0.0)), 6)
    return ranks.agg(F.count("*").alias("queries"), *(within(min(k, top_k) if k == 10 else k).alias(f"recall_{k}") for k in (1, 3, 5, 10)), mrr.alias("mrr"), F.count_if(F.col("rank") < 1).alias("not_found"))


def clamp(limit: int, what: str) -> int:
    """A list's limit: the default for 0 or less, else at most the largest."""
    default, most = LIMITS[what]
    return default if limit <= 0 else min(limit, most)


def newest(df: DataFrame, time_col: str, id_col: str, limit: int, what: str) -> DataFrame:
    return df.orderBy(F.desc(time_col), F.desc(id_col)).limit(clamp(limit, what))


def facets(notes: DataFrame, tags: list[str] | None = None, since: str | None = None, until: str | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Notes with any of the tags, created in the inclusive interval, of any of the kinds by name; an absent, empty or wholly unknown list filters nothing."""
    known = [k for k in (_kind(n) for n in kinds or []) if k is not None]
    if tags:
        notes = notes.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if since:
        notes = notes.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if until:
        notes = notes.filter(F.col("created_at") <= F.lit(until).cast("timestamp"))
    return notes.filter(F.col("kind").isin(known)) if known else notes


def _kind(name: str) -> int | None:
    from notegraph.schemas import NOTE_KINDS

    return {k.upper(): i for i, k in enumerate(NOTE_KINDS)}.get(name.strip().upper())


def kind_counts(notes: DataFrame) -> DataFrame:
    """(kind, n, percent) by falling count; a missing kind is General."""
    counts = notes.groupBy(F.coalesce(kind_name(F.col("kind")), F.lit("General")).alias("kind")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2))  # six rows at most


def per_day(df: DataFrame, time_col: str, now: str, days: int = 30) -> DataFrame:
    """(day, n) of each of the last days up to now's, with zeros."""
    last = F.to_date(F.lit(now).cast("timestamp"))
    line = df.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    counts = df.groupBy(F.to_date(time_col).alias("day")).agg(F.count("*").alias("n"))
    return line.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def edge_states(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count_if(F.col("invalidated_at").isNull()).alias("active"), F.count_if(F.col("invalidated_at").isNotNull()).alias("invalidated"))


