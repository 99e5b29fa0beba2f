"""Source divergence audit: how far the sources of a language are from each other in their terms, and which terms set a source apart.

Each task counts the terms of its documents in DuckDB; the counts are dealt out by language and term to shards. A shard
holds whole terms, so that in DuckDB it sums their counts, tells which are kept, ranks them and sums the parts of all
pairs of sources that hold a term. Spark adds the shards' parts and merges their rankings.

The pairs' sums run over all kept terms, though most terms are in neither source. With f(p, q) the value of a term and 0
the probability of a term that a source lacks, the sum over all terms of f(a, b) is
  terms in both of f(a, b) - f(a, 0) - f(0, b) + f(0, 0)  (summed in the shards, over terms that both hold),
  + terms in a of f(a, 0) + terms in b of f(0, b)          (from the number of terms of each count),
  + (kept terms - terms in a - terms in b) of f(0, 0).
All arithmetic is in integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegraph.llm.common import forget, quoted, small_batches, stored

# The pattern of a term, the documents that make it a kept one, the scale of probabilities, and the terms listed for a source.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS, SCALE, LISTED = 10, 1_000_000_000, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Counts that a task holds before it hands them on, and memory of a task's DuckDB.
HELD, MEMORY = 1_000_000, "512MB"
#: Rows and bytes of an Arrow batch: counts are narrow rows, and for texts the bytes are the bound.
BATCH_ROWS, BATCH_BYTES = 10_000, 16 << 20

COUNTS = "lang string, source string, term string, n long, docs long"
KEPT = "lang string, source string, term string, n long, in_lang long, lead long"
PARTS = "lang string, source string, part string, item string, value long"


def _value(p: str, q: str) -> str:
    return f"(({p}) - ({q})) * (({p}) - ({q})) // (({p}) + ({q}))"


def _database() -> duckdb.DuckDBPyConnection:
    """A task's own, in memory: one thread, since Spark runs as many tasks as there are cores, and no files beside Spark's."""
    return duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": "", "preserve_insertion_order": False})


def _batches(con: duckdb.DuckDBPyConnection, sql: str) -> Iterator[pa.RecordBatch]:
    with con.cursor() as read:
        yield from read.sql(sql).to_arrow_reader(10_000)


def _count(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, text) to partial counts of (lang, source, term), occurrences and documents."""
    con = _database()
    con.execute("CREATE TABLE held (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
    out = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM held GROUP BY ALL"
    rows_held = lambda: con.execute("SELECT count(*) FROM held").fetchall()[0][0]
    for batch in batches:
        con.register("batch", pa.Table.from_batches([batch]))
        con.execute(
            f"""INSERT INTO held SELECT lang, source, term, sum(n), count(*) FROM (SELECT d, lang, source, term, count(*) AS n FROM (SELECT d, lang, source,
              unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM (SELECT *, row_number() OVER () AS d FROM batch)) GROUP BY ALL) GROUP BY lang, source, term"""
        )
        con.unregister("batch")
        if rows_held() > held:
            con.execute(f"CREATE TABLE less AS {out}")
            con.execute("DROP TABLE held")
            con.execute("ALTER TABLE less RENAME TO held")
            if rows_held() > held // 2:
                yield from _batches(con, out)
                con.execute("DELETE FROM held")
    yield from _batches(con, out)
    con.close()


def _loaded(batches: Iterator[pa.RecordBatch], columns: str) -> duckdb.DuckDBPyConnection:
    con = _database()
    con.execute(f"CREATE TABLE shard ({columns})")
    for batch in batches:
        con.register("batch", pa.Table.from_batches([batch]))
        con.execute("INSERT INTO shard SELECT * FROM batch")
        con.unregister("batch")
    return con


def _keep(batches: Iterator[pa.RecordBatch], least_docs: int) -> Iterator[pa.RecordBatch]:
    """A shard's partial counts, whole by term, to counts of kept terms; lead is 1 for one row of each term."""
    con = _loaded(batches, "lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT")
    yield from _batches(
        con,
        f"""SELECT lang, source, term, n, CAST(sum(n) OVER w AS BIGINT) AS in_lang, CAST(source = min(source) OVER w AS BIGINT) AS lead
          FROM (SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, sum(docs) AS docs FROM shard GROUP BY ALL) WINDOW w AS (PARTITION BY lang, term) QUALIFY sum(docs) OVER w >= {least_docs}""",
    )
    con.close()


def _compare(batches: Iterator[pa.RecordBatch], listed: int) -> Iterator[pa.RecordBatch]:
    """A shard's probabilities to the sums of its pairs' shared terms, and to the best terms of each source."""
    con = _loaded(batches, "lang VARCHAR, source VARCHAR, term VARCHAR, p BIGINT, none BIGINT, q BIGINT")
    shared = f"{_value('a.p', 'b.p')} - {_value('a.p', 'b.none')} - {_value('a.none', 'b.p')} + {_value('a.none', 'b.none')}"
    yield from _batches(
        con,
        f"""SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(sum({shared}) AS BIGINT) AS value
          FROM shard a JOIN shard b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL""",
    )
    yield from _batches(
        con,
        f"""SELECT lang, source, 'term' AS part, term AS item, {_value("p", "q")} AS value FROM shard WHERE p > q
          QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY {_value("p", "q")} DESC, term) <= {listed}""",
    )
    con.close()


def _probability(count, n, v):
    """1 + floor(SCALE * (count + 2) / (n + 2 * v)), beyond 64 bits on the way."""
    wide = "decimal(38,0)"
    return F.expr(f"cast(1 + div(cast({SCALE} as {wide}) * ({count} + 2), cast({n} + 2 * {v} as {wide})) as bigint)")


def audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, listed: int = LISTED, held: int = HELD) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language, part pair lists every other source by its divergence over all kept terms, part term the first `listed` terms that set it apart. Terms in least_docs of a language's rows are kept.

    Null texts, languages and sources are empty strings. Rows count each, copies too. A language without kept terms has pairs of value 0 and no terms; a source
    alone in its language has no pairs. Of equal values the lesser item comes first. No rows: none.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    text_of = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(""))
    rows = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), text_of(text_col).alias("text"))
    groups = stored(rows.groupBy("lang", "source").agg(F.count("*").alias("rows")), "groups")
    kept = stored(rows.mapInArrow(partial(_count, held=held), COUNTS).repartition("lang", "term").mapInArrow(partial(_keep, least_docs=least_docs), KEPT), "kept")

    of_lang = kept.groupBy("lang").agg(F.sum("lead").alias("v"), F.sum("n").alias("n_lang"))
    of_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_source"), F.count("*").alias("terms"))
    totals = groups.join(of_lang, "lang", "left").join(of_source, ["lang", "source"], "left").na.fill(0, ["v", "n_lang", "n_source", "terms"])
    totals = stored(totals.select("lang", "source", "v", "n_lang", "n_source", "terms", F.when(F.col("v") > 0, _probability("0L", "n_source", "v")).alias("none")), "totals")

    with_p = kept.join(totals, ["lang", "source"]).select("lang", "source", "term", _probability("n", "n_source", "v").alias("p"), "none", _probability("in_lang", "n_lang", "v").alias("q"))
    with_p = stored(with_p, "probabilities")
    shards = stored(with_p.repartition("lang", "term").mapInArrow(partial(_compare, listed=listed), PARTS), "shards")

    # terms of each probability, so that a source meets the others of its language once for each of them
    f = lambda p, q: F.expr(f"div(({p} - {q}) * ({p} - {q}), {p} + {q})")
    steps = with_p.groupBy("lang", "source", "p").agg(F.count("*").alias("of"))
    others = totals.select("lang", F.col("source").alias("item"), F.col("none").alias("other"))
    lacked = steps.join(others, "lang").filter("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("of") * f("p", "other")).alias("value"))
    ends = totals.join(totals.select("lang", F.col("source").alias("item"), F.col("none").alias("other"), F.col("terms").alias("others")), "lang").filter("source <> item")
    neither = ends.select("lang", "source", "item", F.when(F.col("v") > 0, (F.col("v") - F.col("terms") - F.col("others")) * f("none", "other")).otherwise(F.lit(0)).alias("value"))
    mirrored = lacked.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    shared = shards.filter("part = 'pair'").select("lang", "source", "item", "value")
    pairs = neither.unionByName(lacked).unionByName(mirrored).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    best = shards.filter("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", place).filter(F.col("rank") <= listed)
    out = stored(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", place).unionByName(best), "divergence")
    for used in (groups, kept, totals, with_p, shards):
        forget(used)
    small_batches(spark)
    return out
