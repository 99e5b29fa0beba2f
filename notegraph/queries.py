"""Queries over the driver's tables, one for each operator group, and their DuckDB equivalents.

Outputs are bigint, double (rounded), varchar, boolean and int columns, so that both engines' rows compare.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notegraph import adapters as a
from notegraph.catalog import Scope, ScopedCatalog, admin_gate, resolve_keys
from notegraph.functions import scalars as f
from notegraph.operators import fusion, graph, lexical, memory, mutations, vector
from notegraph.plans.search import Memory, Search, SearchOptions, SearchRequest, context_block
from notegraph.sources import connectors
from notegraph.storage import stored

NOW, T = "2024-02-15 00:00:00", "1996-06-01 00:00:00"
TERMS = ["the", "and", "of"]
HINTS = [(0, "NATION_3"), (1, "europe"), (2, "Supplier#00000000"), (3, "no such name"), (4, "nation_3")]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# Views that the oracle's queries start with.
V_NOTES = """notes AS (SELECT doc_id AS note_id, source AS project_id, text AS content, lang AS context, [lang, source] AS tags, [lang] AS keywords,
  CAST(doc_id % 6 AS INT) AS kind, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INT)) AS created_at,
  CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INT) + 24) END AS superseded_at FROM documents),
 active AS (SELECT * FROM notes WHERE superseded_at IS NULL)"""
V_EDGES = """edges AS (
  SELECT 's:' || l_suppkey AS from_id, 'p:' || l_partkey AS to_id, 'SUPPLIES' AS relation, min(l_shipdate) AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to, CASE WHEN bool_and(l_returnflag = 'R') THEN max(l_shipdate) END AS invalidated_at FROM lineitem GROUP BY l_suppkey, l_partkey
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'IN', NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'IN', NULL, NULL, NULL FROM nation),
 entities AS (SELECT 's:' || s_suppkey AS entity_id, s_name AS name, 'supplier' AS kind FROM supplier UNION ALL SELECT 'p:' || p_partkey, p_name, 'part' FROM part
  UNION ALL SELECT 'n:' || n_nationkey, n_name, 'nation' FROM nation UNION ALL SELECT 'r:' || r_regionkey, r_name, 'region' FROM region),
 mentions AS (SELECT doc_id AS note_id, 's:' || (doc_id % 100) AS entity_id FROM documents UNION ALL SELECT doc_id, 'p:' || (doc_id % 1000) FROM documents)"""
V_REFLECTIONS = """reflections AS (SELECT CAST(strftime(day, '%Y%m%d') AS BIGINT) AS reflection_id, CASE WHEN day(day) % 2 = 0 THEN 'daily' ELSE 'meta' END AS scope, 'events ' || n AS summary, CAST(day AS TIMESTAMP) AS generated_at
  FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1))"""


def _dist(v: str = "embedding", q: str = "(SELECT embedding FROM embeddings WHERE vec_id = 0)") -> str:
    return f"1 - list_cosine_similarity(CAST({v} AS DOUBLE[]), CAST({q} AS DOUBLE[]))"


def _vec(name: str, where: str = "TRUE", q: int = 0, k: int = 20) -> str:
    d = _dist(q=f"(SELECT embedding FROM embeddings WHERE vec_id = {q})")
    return f"""{name} AS (SELECT note_id, distance, CAST(row_number() OVER (ORDER BY distance, note_id) AS INT) AS rank FROM
  (SELECT note_id, {d} AS distance FROM embeddings JOIN active ON vec_id = note_id WHERE {where} ORDER BY distance, note_id LIMIT {k}))"""


def _count(x: str, t: str) -> str:
    return f"len(list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t = '{t}'))"


def _term(t: str) -> str:
    return f"({_count('content', t)} * 1.0::DOUBLE + {_count('context', t)} * 0.4::DOUBLE + {_count('context', t)} * 0.2::DOUBLE + {_count('array_to_string(tags, chr(32))', t)} * 0.1::DOUBLE)"


V_LEX = f"""lex AS (SELECT note_id, score, CAST(row_number() OVER (ORDER BY score DESC, note_id) AS INT) AS rank FROM
  (SELECT note_id, round({' + '.join(map(_term, TERMS))}, 6) AS score FROM active WHERE {' AND '.join(_term(t) + ' > 0' for t in TERMS)} ORDER BY score DESC, note_id LIMIT 20))"""
#: Ranks of mentions by a mass that needs no iteration: a node's degree.
V_DEG = """deg AS (SELECT note_id, CAST(row_number() OVER (ORDER BY n DESC, note_id) AS INT) AS rank FROM (SELECT note_id, sum(d) AS n FROM mentions JOIN (SELECT from_id AS entity_id, count(*) AS d FROM edges GROUP BY 1) USING (entity_id) GROUP BY 1 ORDER BY n DESC, note_id LIMIT 30))"""
V_IMG = f"""img AS (SELECT note_id, CAST(row_number() OVER (ORDER BY distance, note_id, image_id) AS INT) AS rank, image_id, distance FROM
  (SELECT vec_id % 100 AS note_id, vec_id AS image_id, {_dist()} AS distance FROM embeddings WHERE vec_id % 100 IN (SELECT note_id FROM active) ORDER BY distance, note_id, image_id LIMIT 20))"""


def _fused(name: str, **streams: str) -> str:
    order = {"vector": 0, "lexical": 1, "graph": 2, "image": 3}
    pool = " UNION ALL ".join(f"SELECT note_id, rank, '{s}' AS stream, {order[s]} AS place FROM {t}" for s, t in streams.items())
    return f"""{name} AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, seen, note_id) AS INT) AS position FROM (SELECT note_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score,
  max(CASE WHEN stream IN ('vector', 'image') THEN 1.0::DOUBLE / (60 + rank) END) AS vector_score, max(CASE WHEN stream = 'lexical' THEN 1.0::DOUBLE / (60 + rank) END) AS lexical_score,
  max(CASE WHEN stream = 'graph' THEN 1.0::DOUBLE / (60 + rank) END) AS graph_score, min(place * 100000 + rank) AS seen FROM ({pool}) GROUP BY note_id))"""


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def _vector_of(spark: SparkSession, sf: str, vec_id: int = 0) -> list[float]:
    """One query's vector: a point lookup of one row."""
    found = a.read(spark, sf, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return list(found[0]) if found else []


def _active(spark: SparkSession, sf: str) -> DataFrame:
    return a.notes(spark, sf).filter("superseded_at is null")


def _vector(spark, sf, notes=None, q=0, k=20):
    return vector.top_k(notes if notes is not None else _active(spark, sf), a.note_embeddings(spark, sf), _vector_of(spark, sf, q), k)


def _lex(spark, sf):
    return lexical.top_k(_active(spark, sf), TERMS, 20)


def _deg(spark, sf):
    d = a.edges(spark, sf).groupBy(F.col("from_id").alias("entity_id")).agg(F.count("*").alias("d"))
    top = a.mentions(spark, sf).join(d, "entity_id").groupBy("note_id").agg(F.sum("d").alias("n")).orderBy(F.desc("n"), "note_id").limit(30)
    return vector.ranked(top, F.desc("n"), "note_id")


def _img(spark, sf):
    return vector.top_k(_active(spark, sf), a.image_embeddings(spark, sf), _vector_of(spark, sf), 20)


def _hits(spark, sf):
    return fusion.fuse({"vector": _vector(spark, sf), "lexical": _lex(spark, sf)})


def _r(col: str, digits: int = 6):
    return F.round(col, digits).alias(col)


def _stamp(col: str, name: str | None = None):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(name or col)


SCORES = "SELECT doc_id AS note_id, round((doc_id % 10)::DOUBLE / 10, 6) AS rerank FROM documents"


def _scores(spark, sf):
    return a.read(spark, sf, "documents").select(F.col("doc_id").alias("note_id"), F.round((F.col("doc_id") % 10).cast("double") / 10, 6).alias("rerank"))


# --- ranking -----------------------------------------------------------------------------------


@query(f"WITH {V_NOTES}, {_vec('v')} SELECT rank, note_id, round(distance, 6) AS distance FROM v")
def vector_topk(spark, sf):
    return _vector(spark, sf).select("rank", "note_id", _r("distance"))


@query(f"WITH {V_NOTES}, {_vec('v', '''list_has_any(tags, ['en', 'fr']) AND created_at >= TIMESTAMP '2024-01-02' AND created_at <= TIMESTAMP '2024-01-15' AND kind IN (1, 2, 5)''')} SELECT rank, note_id, round(distance, 6) AS distance FROM v")
def vector_topk_filtered(spark, sf):
    notes = memory.facets(_active(spark, sf), ["en", "fr"], "2024-01-02 00:00:00", "2024-01-15 00:00:00", ["observation", "DECISION", "pattern", "unheard of"])
    return _vector(spark, sf, notes).select("rank", "note_id", _r("distance"))


@query(f"""WITH {V_NOTES}, {_vec('v0')}, {_vec('v1', q=1)} SELECT note_id, CAST(row_number() OVER (ORDER BY score DESC, seen, note_id) AS INT) AS rank FROM
 (SELECT note_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(place * 100000 + rank) AS seen FROM (SELECT *, 0 AS place FROM v0 UNION ALL SELECT *, 1 FROM v1) GROUP BY 1)""")
def variant_merge(spark, sf):
    return fusion.merge_variants([_vector(spark, sf), _vector(spark, sf, q=1)])


@query(f"WITH {V_NOTES}, {V_IMG} SELECT rank, note_id, image_id, round(distance, 6) AS distance FROM img")
def image_topk_multi(spark, sf):
    return _img(spark, sf).select("rank", "note_id", "image_id", _r("distance"))


@query(f"WITH {V_NOTES} SELECT count(*) AS n FROM active WHERE {' AND '.join(_term(t) + ' > 0' for t in TERMS)}")
def lexical_and_match(spark, sf):
    words = f.terms(F.concat_ws(" ", "content", "context", F.concat_ws(" ", "tags")))
    return _active(spark, sf).filter(F.size(F.array_except(F.array(*map(F.lit, TERMS)), words)) == 0).agg(F.count("*").alias("n"))


@query(f"WITH {V_NOTES}, {V_LEX} SELECT rank, note_id, score FROM lex")
def lexical_rank(spark, sf):
    return _lex(spark, sf).select("rank", "note_id", "score")


_PLACED = """f AS (SELECT note_id, regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+') AS a, regexp_split_to_array(lower(context), '[^\\p{L}\\p{N}]+') AS b, regexp_split_to_array(lower(array_to_string(tags, ' ')), '[^\\p{L}\\p{N}]+') AS d FROM active),
 g AS (SELECT note_id, list_filter(a, lambda t: t <> '') AS a, list_filter(b, lambda t: t <> '') AS b, list_filter(d, lambda t: t <> '') AS d FROM f),
 w AS (SELECT note_id, unnest(a) AS word, unnest(range(1, len(a) + 1)) AS pos, 1.0::DOUBLE AS weight FROM g UNION ALL SELECT note_id, unnest(b), unnest(range(len(a) + 1, len(a) + len(b) + 1)), 0.4 FROM g
  UNION ALL SELECT note_id, unnest(b), unnest(range(len(a) + len(b) + 1, len(a) + 2 * len(b) + 1)), 0.2 FROM g UNION ALL SELECT note_id, unnest(d), unnest(range(len(a) + 2 * len(b) + 1, len(a) + 2 * len(b) + len(d) + 1)), 0.1 FROM g),
 t AS (SELECT * FROM (SELECT DISTINCT note_id, word, least(pos, 16383) AS pos, weight FROM w WHERE word IN ('the', 'and', 'of', 'src3')) QUALIFY row_number() OVER (PARTITION BY note_id, word ORDER BY pos, weight DESC) <= 255),
 pair AS (SELECT x.note_id, sum(ln(1 - sqrt(x.weight * y.weight * CASE WHEN abs(x.pos - y.pos) > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(abs(x.pos - y.pos) / 1.5 - 2)) END))) AS unsaid
  FROM t x JOIN t y ON x.note_id = y.note_id AND x.word < y.word AND x.pos <> y.pos WHERE x.word <> 'src3' AND y.word <> 'src3' GROUP BY 1),
 all_of AS (SELECT note_id, round(CASE WHEN 1 - exp(unsaid) > 0 THEN 1 - exp(unsaid) ELSE 1e-20 END, 6) AS score FROM pair WHERE note_id IN (SELECT note_id FROM t WHERE word <> 'src3' GROUP BY 1 HAVING count(DISTINCT word) = 3)),
 n AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY pos) AS j FROM t WHERE word = 'src3'),
 one AS (SELECT note_id, round((max(weight) + sum(weight / (j * j)) - max(weight) / pow(arg_min(j, (-weight, j)), 2)) / 1.64493406685, 6) AS score FROM n GROUP BY 1)"""


@query(f"""WITH {V_NOTES}, {_PLACED}, r AS (SELECT 'the and of' AS query, note_id, score, row_number() OVER (ORDER BY score DESC, note_id) AS rank FROM all_of UNION ALL SELECT 'src3', note_id, score, row_number() OVER (ORDER BY score DESC, note_id) FROM one)
 SELECT query, note_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 50""")
def ts_rank(spark, sf):
    """Notes that hold all terms, by how near each other they stand; and those of one term, by its occurrences."""
    of = lambda q: lexical.top_k_positions(_active(spark, sf), q.split(), 50).select(F.lit(q).alias("query"), "note_id", "score", "rank")
    return of("the and of").unionByName(of("src3"))


@query("""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS w FROM documents),
 c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda t: t = 'thing')) AS a, len(list_filter(w, lambda t: t = 'with')) AS b FROM w),
 s AS (SELECT count(*) AS d, avg(n) AS m, sum(CASE WHEN a > 0 THEN 1 ELSE 0 END) AS da, sum(CASE WHEN b > 0 THEN 1 ELSE 0 END) AS db FROM c),
 r AS (SELECT doc_id AS note_id, round(ln((d - da + 0.5::DOUBLE) / (da + 0.5::DOUBLE) + 1) * a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / m)) + ln((d - db + 0.5::DOUBLE) / (db + 0.5::DOUBLE) + 1) * b * 2.2::DOUBLE / (b + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / m)), 6) AS score FROM c, s WHERE a > 0 OR b > 0)
 SELECT CAST(row_number() OVER (ORDER BY score DESC, note_id) AS INT) AS rank, note_id, score FROM r ORDER BY score DESC, note_id LIMIT 20""")
def okapi_rank(spark, sf):
    return lexical.okapi(a.raw_notes(spark, sf), ["thing", "with"], 20).select("rank", "note_id", "score")


@query("""SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS term FROM documents) GROUP BY 1""")
def postings_df(spark, sf):
    posts = lexical.postings(a.raw_notes(spark, sf).select("note_id", "content"))
    return posts.select("term", "note_id").distinct().groupBy("term").agg(F.count("*").alias("df"))


_FUSED = "note_id, score, round(vector_score, 9) AS vector_score, round(lexical_score, 9) AS lexical_score, round(graph_score, 9) AS graph_score, position"


@query(f"WITH {V_NOTES}, {_vec('v')}, {V_LEX}, {_fused('p', vector='v', lexical='lex')} SELECT note_id, round(score, 9) AS score, position FROM p")
def rrf_fuse_two(spark, sf):
    return _hits(spark, sf).select("note_id", _r("score", 9), "position")


def _four(spark, sf):
    return fusion.fuse({"vector": _vector(spark, sf), "lexical": _lex(spark, sf), "graph": _deg(spark, sf), "image": _img(spark, sf)})


_FOUR = f"{V_NOTES}, {V_EDGES}, {_vec('v')}, {V_LEX}, {V_DEG}, {V_IMG}, {_fused('p', vector='v', lexical='lex', graph='deg', image='img')}"


@query(f"WITH {_FOUR} SELECT note_id, round(score, 9) AS score, position FROM p")
def rrf_fuse_four(spark, sf):
    return _four(spark, sf).select("note_id", _r("score", 9), "position")


@query(f"WITH {_FOUR} SELECT note_id, round(vector_score, 9) AS vector_score, round(lexical_score, 9) AS lexical_score, round(graph_score, 9) AS graph_score, vector_score IS NOT NULL AS from_vector, lexical_score IS NOT NULL AS from_lexical, graph_score IS NOT NULL AS from_graph FROM p")
def fuse_provenance(spark, sf):
    return _four(spark, sf).select("note_id", *(_r(f"{s}_score", 9) for s in ("vector", "lexical", "graph")), "from_vector", "from_lexical", "from_graph")


_TWO = f"{V_NOTES}, {_vec('v')}, {V_LEX}, {_fused('p', vector='v', lexical='lex')}"
_DECAYED = f"{_TWO}, d AS (SELECT note_id, round(score * greatest(0.05::DOUBLE, exp(-0.6931471805599453::DOUBLE / 30 * greatest(0, epoch_us(TIMESTAMP '{NOW}' - created_at) / 1e6 / 86400.0))), 12) AS score, position AS p0 FROM p JOIN notes USING (note_id))"


@query(f"WITH {_DECAYED} SELECT note_id, round(score, 9) AS score, CAST(row_number() OVER (ORDER BY score DESC, p0) AS INT) AS position FROM d")
def time_decay(spark, sf):
    return fusion.time_decay(_hits(spark, sf), a.raw_notes(spark, sf), NOW).select("note_id", _r("score", 9), "position")


@query(f"WITH {_TWO}, s AS ({SCORES}) SELECT note_id, coalesce(rerank, 0) AS score, CAST(row_number() OVER (ORDER BY rerank DESC, position) AS INT) AS position FROM p LEFT JOIN s USING (note_id) WHERE position <= 20 AND coalesce(rerank, 0) >= 0.10")
def rerank_scores(spark, sf):
    return fusion.rerank(_hits(spark, sf), _scores(spark, sf)).select("note_id", "score", "position")


@query(f"WITH {_TWO} SELECT score < 0.025 AS abstain, CASE WHEN score < 0.025 THEN 'fused score too low' END AS reason, (SELECT count(*) FROM p) AS total_candidates FROM p WHERE position = 1")
def abstain_decision(spark, sf):
    return fusion.decision(_hits(spark, sf))


@query("""WITH h AS (SELECT doc_id AS note_id, CAST(row_number() OVER (ORDER BY n_chars, doc_id) AS INT) AS position, text FROM (SELECT * FROM documents ORDER BY n_chars, doc_id LIMIT 40)),
 c AS (SELECT note_id, position, sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 3.8::DOUBLE)) END + 32) OVER (ORDER BY position) AS tokens FROM h)
 SELECT note_id, position, CAST(tokens AS BIGINT) AS tokens FROM c WHERE position = 1 OR tokens <= 1000""")
def token_pack(spark, sf):
    hits = vector.ranked(a.read(spark, sf, "documents").orderBy("n_chars", "doc_id").limit(40), "n_chars", "doc_id").select(F.col("doc_id").alias("note_id"), F.col("rank").alias("position"), F.col("text").alias("content"))
    return fusion.pack(hits, 1000).select("note_id", "position", "tokens")


class _Fixed:
    """An embedder that answers with one stored vector."""

    name, dimensions = "stored", 64

    def __init__(self, v):
        self.v = v

    def embed(self, texts):
        return [self.v for _ in texts]


@query(f"""WITH {_TWO}, k AS (SELECT * FROM p WHERE position <= 5), go AS (SELECT coalesce(max(score), 0) >= 0.025 AS ok FROM k),
 c AS (SELECT note_id, score, position, length(content) AS n_chars, sum(greatest(1, ceil(length(content) / 3.8::DOUBLE)) + 32) OVER (ORDER BY position) AS tokens FROM k JOIN notes USING (note_id) WHERE (SELECT ok FROM go))
 SELECT note_id, round(score, 9) AS score, position, n_chars, CAST(tokens AS BIGINT) AS tokens FROM c WHERE position = 1 OR tokens <= 4000""")
def hybrid_search(spark, sf):
    """The flagship: vector and lexical streams, fused, cut to five, checked for abstention and packed."""
    m = Memory(a.notes(spark, sf), a.note_embeddings(spark, sf))
    found = Search(spark, m, _Fixed(_vector_of(spark, sf)), options=SearchOptions(now=NOW)).run(SearchRequest("the and of", max_results=5, max_tokens=4000))
    return found.hits.select("note_id", _r("score", 9), "position", F.char_length("content").cast("long").alias("n_chars"), "tokens")


def _whole_search(spark, sf):
    m = Memory(a.notes(spark, sf), a.note_embeddings(spark, sf), a.entities(spark, sf), a.edges(spark, sf), a.mentions(spark, sf), a.image_embeddings(spark, sf))
    return Search(spark, m, _Fixed(_vector_of(spark, sf)), options=SearchOptions(now=NOW)).run(SearchRequest("a the of", max_results=5, max_tokens=4000))


@query()
def hybrid_search_four(spark, sf):
    """hybrid_search over the whole memory: vector, lexical, personalized PageRank and image streams."""
    return _whole_search(spark, sf).hits.select("note_id", _r("score", 9), "position", "from_vector", "from_lexical", "from_graph", F.char_length("content").cast("long").alias("n_chars"), "tokens")


# --- graph -------------------------------------------------------------------------------------


@query(f"""WITH {V_EDGES}, e AS (SELECT entity_id FROM entities WHERE contains(lower(name), 'nation_3') ORDER BY lower(name) = 'nation_3' DESC, name, entity_id LIMIT 1)
 SELECT entity_id, direction, relation, other_id, invalidated FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY relation, other_id) AS n FROM (
  SELECT entity_id, 'out' AS direction, relation, to_id AS other_id, invalidated_at IS NOT NULL AS invalidated FROM edges JOIN e ON from_id = entity_id UNION ALL
  SELECT entity_id, 'in', relation, from_id, invalidated_at IS NOT NULL FROM edges JOIN e ON to_id = entity_id)) WHERE n <= 25""")
def entity_lookup(spark, sf):
    return graph.lookup(a.entities(spark, sf), a.edges(spark, sf), "Nation_3")


@query(f"WITH {V_EDGES} SELECT entity_id, name, kind FROM entities WHERE contains(lower(name), 'ring') ORDER BY name, entity_id LIMIT 50")
def entity_scan(spark, sf):
    return graph.find_entities(a.entities(spark, sf), "RING")


@query(f"WITH {V_EDGES}, v AS (SELECT entity_id FROM entities WHERE kind IN ('nation', 'region')) SELECT from_id, to_id, relation FROM edges WHERE from_id IN (SELECT * FROM v) AND to_id IN (SELECT * FROM v)")
def neighbours_1hop(spark, sf):
    return graph.edges_between(a.edges(spark, sf), a.entities(spark, sf).filter("kind in ('nation', 'region')")).select("from_id", "to_id", "relation")


@query(f"WITH {V_EDGES} SELECT relation, count(*) AS n, min(from_id || '>' || to_id) AS least FROM edges WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '{T}') AND (valid_to IS NULL OR valid_to > TIMESTAMP '{T}') AND invalidated_at IS NULL GROUP BY 1")
def edges_valid_at(spark, sf):
    kept = a.edges(spark, sf).filter(graph.valid_at(F.lit(T).cast("timestamp")))
    return kept.groupBy("relation").agg(F.count("*").alias("n"), F.min(F.concat("from_id", F.lit(">"), "to_id")).alias("least"))


@query(f"WITH {V_EDGES} SELECT relation, count(*) AS n, max(from_id || '>' || to_id) AS most FROM edges WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '{T}') AND (invalidated_at IS NULL OR invalidated_at > TIMESTAMP '{T}') GROUP BY 1")
def edges_known_at(spark, sf):
    kept = a.edges(spark, sf).filter(graph.known_at(F.lit(T).cast("timestamp")))
    return kept.groupBy("relation").agg(F.count("*").alias("n"), F.max(F.concat("from_id", F.lit(">"), "to_id")).alias("most"))


_HINTS_SQL = "hints AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{h.lower()}')" for i, h in HINTS) + ") t(position, hint))"
_SEEDS = f"""{_HINTS_SQL}, m AS (SELECT position, entity_id, row_number() OVER (PARTITION BY position ORDER BY lower(name) <> hint, name, entity_id) AS n FROM hints JOIN entities ON contains(lower(name), hint)),
 seeds AS (SELECT entity_id FROM (SELECT entity_id, min(position) AS p FROM m WHERE n = 1 GROUP BY 1) ORDER BY p LIMIT 8)"""


def _seeds(spark, sf):
    return graph.seeds(a.entities(spark, sf), spark.createDataFrame(HINTS, "position int, hint string"))


@query(f"WITH {V_EDGES}, {_SEEDS} SELECT entity_id FROM seeds")
def seed_resolution(spark, sf):
    return _seeds(spark, sf)


_WALK = """both_ways AS (SELECT from_id AS a, to_id AS b FROM edges WHERE invalidated_at IS NULL UNION ALL SELECT to_id, from_id FROM edges WHERE invalidated_at IS NULL),
 walk AS MATERIALIZED (SELECT a, b, count(*)::DOUBLE / any_value(d) AS w FROM both_ways JOIN (SELECT a, count(*) AS d FROM both_ways GROUP BY 1) USING (a) GROUP BY a, b),
 p0 AS (SELECT entity_id, 1.0::DOUBLE / (SELECT count(*) FROM seeds) AS p FROM seeds)""" + "".join(
    f""",
 p{i + 1} AS MATERIALIZED (SELECT entity_id, sum(p) AS p FROM (SELECT b AS entity_id, p * w * 0.85::DOUBLE AS p FROM p{i} JOIN walk ON entity_id = a UNION ALL
  SELECT entity_id, p * 0.85::DOUBLE FROM p{i} WHERE entity_id NOT IN (SELECT a FROM walk) UNION ALL SELECT entity_id, p * 0.15::DOUBLE FROM p0) GROUP BY 1)"""
    for i in range(8)
)


def _mass(spark, sf):
    return graph.ppr(a.edges(spark, sf).filter("invalidated_at is null"), _seeds(spark, sf))


@query(f"WITH {V_EDGES}, {_SEEDS}, {_WALK} SELECT entity_id, round(p, 9) AS mass FROM p8 WHERE p > 0")
def ppr_mass(spark, sf):
    return _mass(spark, sf).select("entity_id", _r("mass", 9))


@query(f"""WITH {V_NOTES}, {V_EDGES}, {_SEEDS}, {_WALK}, t AS (SELECT note_id, round(sum(p), 12) AS mass FROM mentions JOIN p8 USING (entity_id) GROUP BY 1 ORDER BY mass DESC, note_id LIMIT 30)
 SELECT note_id, round(mass, 9) AS mass, CAST(row_number() OVER (ORDER BY mass DESC, note_id) AS INT) AS rank FROM t JOIN active USING (note_id)""")
def ppr_note_rank(spark, sf):
    return graph.note_ranks(_mass(spark, sf), a.mentions(spark, sf), a.notes(spark, sf)).select("note_id", _r("mass", 9), "rank")


# --- mutations ---------------------------------------------------------------------------------


def _old_entities(spark, sf):
    s = a.read(spark, sf, "supplier")
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    return s.select(F.lit("p").alias("project_id"), F.col("s_name").alias("name"), F.concat(F.lit("old:"), "s_suppkey").alias("entity_id"), F.lit("supplier").alias("kind"), F.create_map(F.lit("bal"), F.col("s_acctbal").cast("string")).alias("attributes"), at.alias("first_seen_at"), at.alias("last_seen_at"))


@query("""WITH o AS (SELECT s_name AS name, 'old:' || s_suppkey AS id FROM supplier), n AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE s_name || ' Ltd' END AS name, min(s_suppkey) AS k FROM supplier GROUP BY 1)
 SELECT coalesce(o.name, n.name) AS name, coalesce(o.id, 'new:' || n.k) AS entity_id, CASE WHEN n.k IS NULL THEN 'supplier' ELSE 'vendor' END AS kind, o.id IS NOT NULL AS first_seen_old, n.k IS NOT NULL AS last_seen_new FROM o FULL JOIN n ON o.name = n.name""")
def entity_upsert(spark, sf):
    """All suppliers told of once more, every third under its old name."""
    s = a.read(spark, sf, "supplier").withColumn("s_name", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(F.concat("s_name", F.lit(" Ltd"))))
    at = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    new = s.select(F.lit("p").alias("project_id"), F.col("s_name").alias("name"), F.concat(F.lit("new:"), "s_suppkey").alias("entity_id"), F.lit("vendor").alias("kind"), F.create_map(F.lit("k"), F.col("s_suppkey").cast("string")).alias("attributes"), at.alias("seen_at"), F.col("s_suppkey").alias("seq"))
    merged = mutations.upsert_entities(_old_entities(spark, sf), new)
    return merged.select("name", "entity_id", "kind", (F.col("first_seen_at") < at).alias("first_seen_old"), (F.col("last_seen_at") == at).alias("last_seen_new"))


def _old_edges(spark, sf):
    e = a.edges(spark, sf).filter("relation = 'SUPPLIES'")
    return e.select(F.lit("p").alias("project_id"), "from_id", "to_id", "relation", F.lit("old").alias("edge_id"), F.col("valid_from").alias("recorded_at"), "valid_from", "valid_to", F.create_map(F.lit("v"), F.lit("1")).alias("properties"), "invalidated_at")


@query(f"""WITH {V_EDGES}, o AS (SELECT * FROM edges WHERE relation = 'SUPPLIES'), n AS (SELECT DISTINCT 's:' || s_suppkey AS from_id, 'p:' || p_partkey AS to_id FROM supplier JOIN part ON s_suppkey = p_partkey)
 SELECT count(*) AS edges, CAST(sum(CASE WHEN o.from_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS fresh, CAST(sum(CASE WHEN n.from_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS asserted, count(o.invalidated_at) AS invalidated FROM o FULL JOIN n USING (from_id, to_id)""")
def edge_merge(spark, sf):
    s, p = a.read(spark, sf, "supplier"), a.read(spark, sf, "part")
    at = F.to_timestamp(F.lit(NOW))
    new = s.join(p, F.col("s_suppkey") == F.col("p_partkey")).select(F.lit("p").alias("project_id"), F.concat(F.lit("s:"), "s_suppkey").alias("from_id"), F.concat(F.lit("p:"), "p_partkey").alias("to_id"), F.lit("SUPPLIES").alias("relation"), F.lit("new").alias("edge_id"), at.alias("recorded_at"), at.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.create_map(F.lit("v"), F.lit("2")).alias("properties"), F.lit(1).alias("seq"))
    m = mutations.upsert_edges(_old_edges(spark, sf), new)
    return m.agg(F.count("*").alias("edges"), F.count_if(F.col("edge_id") == "new").alias("fresh"), F.count_if(F.col("properties")["v"] == "2").alias("asserted"), F.count("invalidated_at").alias("invalidated"))


@query(f"""WITH {V_EDGES} SELECT from_id, to_id, relation, CASE WHEN from_id IN ('n:1', 'n:2') OR invalidated_at IS NOT NULL THEN 'gone' ELSE 'kept' END AS state FROM edges""")
def edge_supersede(spark, sf):
    rows = [("e1", "nation_1", "AFRICA", "IN"), ("e1", "Nation_2", "region:own", "IN"), ("e1", "nobody", "AFRICA", "IN"), ("e1", "NATION_3", "AFRICA", "  ")]
    triples = spark.createDataFrame(rows, "episode_id string, from_name string, to_name string, relation string")
    nations = a.read(spark, sf, "nation").filter("n_nationkey in (1, 2)")
    own = nations.select(F.lit("e1").alias("episode_id"), F.col("n_name").alias("name"), F.concat(F.lit("n:"), "n_nationkey").alias("entity_id"))
    region = nations.filter("n_nationkey = 2").select(F.lit("e1").alias("episode_id"), F.lit("REGION:OWN").alias("name"), F.concat(F.lit("r:"), "n_regionkey").alias("entity_id"))
    africa = nations.filter("n_nationkey = 1").select(F.lit("e1").alias("episode_id"), F.lit("africa").alias("name"), F.concat(F.lit("r:"), "n_regionkey").alias("entity_id"))
    hits = mutations.resolve_edges(triples, own.unionByName(region).unionByName(africa), a.entities(spark, sf))
    return mutations.invalidate(a.edges(spark, sf), hits, NOW).select("from_id", "to_id", "relation", F.when(F.col("invalidated_at").isNotNull(), "gone").otherwise("kept").alias("state"))


@query("""SELECT c.conv_id * 1000 + c.turn AS note_id, count(DISTINCT d.role) AS entities FROM conversations c JOIN conversations d ON c.conv_id = d.conv_id GROUP BY 1""")
def mentions_cross(spark, sf):
    c = a.read(spark, sf, "conversations")
    notes = c.select(F.col("conv_id").alias("episode_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("note_id"))
    own = c.select(F.col("conv_id").alias("episode_id"), F.col("role").alias("entity_id"))
    return mutations.mentions(notes, own.distinct()).groupBy("note_id").agg(F.count("*").alias("entities"))


@query(f"WITH {V_NOTES} SELECT count(*) AS n, count(CASE WHEN superseded_at IS NOT NULL OR note_id % 7 = 0 THEN 1 END) AS superseded FROM notes")
def note_supersede_dup(spark, sf):
    notes = a.notes(spark, sf)
    i = F.col("note_id")
    judged = notes.select("note_id", F.when(i % 7 == 0, "Duplicates").otherwise("related-to").alias("relation_type"), F.lit(0.9).alias("confidence")).unionByName(notes.select("note_id", F.lit("duplicates").alias("relation_type"), F.lit(0.89).alias("confidence")))
    return mutations.supersede(notes, judged, NOW).agg(F.count("*").alias("n"), F.count("superseded_at").alias("superseded"))


@query("""SELECT 'orders without customer' AS what, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL
 SELECT 'labels without document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'vectors without document', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)""")
def integrity_orphans(spark, sf):
    t = lambda n: a.read(spark, sf, n)
    checks = (("orders without customer", "orders", "customer", "o_custkey", "c_custkey"), ("labels without document", "labels", "documents", "doc_id", "doc_id"), ("vectors without document", "embeddings", "documents", "vec_id", "doc_id"))
    made = [mutations.orphans(t(c), t(p), ck, pk).agg(F.lit(what).alias("what"), F.count("*").alias("n")) for what, c, p, ck, pk in checks]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query("SELECT count(*) AS n, CAST(sum(CASE WHEN c_nationkey = 3 THEN 1 ELSE 0 END) AS BIGINT) AS nulled FROM customer")
def cascade_set_null(spark, sf):
    gone = a.read(spark, sf, "nation").filter("n_nationkey = 3")
    left = mutations.cascade(a.read(spark, sf, "customer"), gone, "c_nationkey", "n_nationkey", set_null=True)
    return left.agg(F.count("*").alias("n"), F.count_if(F.col("c_nationkey").isNull()).alias("nulled"))


# --- memory ------------------------------------------------------------------------------------

_KNN = f"""k AS (SELECT source_id, target_id, d FROM (SELECT x.vec_id AS source_id, y.vec_id AS target_id, 1 - list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS d,
  row_number() OVER (PARTITION BY x.vec_id ORDER BY round(1 - list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 12), y.vec_id) AS n
  FROM (SELECT * FROM embeddings WHERE vec_id IN (SELECT note_id FROM active)) x JOIN (SELECT * FROM embeddings WHERE vec_id IN (SELECT note_id FROM active)) y ON x.vec_id <> y.vec_id) WHERE n <= 5)"""


@query(f"WITH {V_NOTES}, {_KNN} SELECT source_id, target_id, round(greatest(0, 1 - d), 6) AS similarity FROM k WHERE greatest(0, 1 - d) >= 0.30")
def link_knn(spark, sf):
    return memory.link(a.note_embeddings(spark, sf), a.notes(spark, sf)).select("source_id", "target_id", _r("similarity"))


@query(f"WITH {V_NOTES}, {_KNN} SELECT source_id, target_id, CASE WHEN target_id % 3 = 0 THEN 'related-to' ELSE 'supports' END AS relation_type FROM k WHERE greatest(0, 1 - d) >= 0.30 AND (source_id + target_id) % 2 = 0 AND target_id % 5 <> 0")
def link_judged(spark, sf):
    links = stored(memory.link(a.note_embeddings(spark, sf), a.notes(spark, sf)), "links")  # read three times
    j = links.select("source_id", "target_id", ((F.col("source_id") + F.col("target_id")) % 2 == 0).alias("related"), F.when(F.col("target_id") % 3 == 0, " ").otherwise("supports").alias("relation_type"), F.lit(0.6).alias("confidence"))
    old = links.filter("target_id % 5 = 0").select("source_id", "target_id")
    return memory.judged_links(links, j, old).select("source_id", "target_id", "relation_type")


@query(f"WITH {V_NOTES}, r AS (SELECT vec_id AS target_id, (vec_id * 37 % 101)::DOUBLE / 101 AS confidence FROM embeddings WHERE vec_id <> 0 ORDER BY confidence DESC, target_id LIMIT 7) SELECT note_id, round(confidence, 6) AS confidence FROM r JOIN notes ON note_id = target_id")
def related_notes(spark, sf):
    rel = a.read(spark, sf, "embeddings").filter("vec_id <> 0").select(F.lit(0).cast("long").alias("source_id"), F.col("vec_id").alias("target_id"), ((F.col("vec_id") * 37 % 101).cast("double") / 101).alias("confidence"))
    return memory.related_notes(rel, a.raw_notes(spark, sf), 0, 7).select("note_id", _r("confidence"))


_WINDOW = f"w AS (SELECT * FROM active WHERE created_at BETWEEN TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND TIMESTAMP '2024-01-20' ORDER BY created_at DESC, note_id DESC LIMIT 30)"


@query(f"WITH {V_NOTES}, {_WINDOW} SELECT note_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM w")
def reflection_window(spark, sf):
    return memory.reflection_window(a.notes(spark, sf), "2024-01-20 00:00:00").select("note_id", _stamp("created_at"))


@query(f"WITH {V_REFLECTIONS} SELECT reflection_id, scope, summary FROM reflections WHERE scope <> 'meta' AND generated_at BETWEEN TIMESTAMP '{NOW}' - INTERVAL 90 DAY AND TIMESTAMP '{NOW}' ORDER BY generated_at DESC, reflection_id DESC LIMIT 30")
def reflection_meta_window(spark, sf):
    return memory.meta_window(a.reflections(spark, sf), "meta", NOW).select("reflection_id", "scope", "summary")


@query(f"WITH {V_NOTES}, {_WINDOW} SELECT coalesce(string_agg('- [' || strftime(created_at, '%Y-%m-%d') || '] (' || context || ') ' || content, chr(10) ORDER BY created_at DESC, note_id DESC), '') AS body, count(*) AS n FROM w")
def reflection_body(spark, sf):
    return memory.reflection_body(memory.reflection_window(a.notes(spark, sf), "2024-01-20 00:00:00"))


@query("SELECT coalesce(quality = 1, TRUE) AS keep, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def importance_gate(spark, sf):
    e = a.read(spark, sf, "documents").select(F.col("doc_id").alias("episode_id"))
    j = a.read(spark, sf, "labels").select(F.col("doc_id").alias("episode_id"), F.lit(True).alias("save"), F.col("quality").cast("double").alias("score"))
    return memory.gate(e, j).groupBy("keep").agg(F.count("*").alias("n"))


_GOLD = "g AS (SELECT item_id AS query_id, item_id % 13 AS gold_id FROM benchmark), h AS (SELECT item_id AS query_id, (item_id + p) % 13 AS note_id, CAST(p + 1 AS INT) AS position FROM benchmark, (SELECT unnest(range(10)) AS p) WHERE p >= item_id % 4)"


def _gold(spark, sf):
    b = a.read(spark, sf, "benchmark")
    gold = b.select(F.col("item_id").alias("query_id"), (F.col("item_id") % 13).alias("gold_id"))
    hits = b.select("item_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("p")).filter("p >= item_id % 4").select(F.col("item_id").alias("query_id"), ((F.col("item_id") + F.col("p")) % 13).alias("note_id"), (F.col("p") + 1).alias("position"))
    return memory.gold_ranks(gold, hits)


@query(f"""WITH {_GOLD}, r AS (SELECT g.query_id, coalesce(min(position), -1) AS rank FROM g LEFT JOIN h ON g.query_id = h.query_id AND gold_id = note_id GROUP BY 1)
 SELECT count(*) AS queries, {', '.join(f"round(avg(CASE WHEN rank BETWEEN 1 AND {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_{k}" for k in (1, 3, 5, 10))}, round(avg(CASE WHEN rank >= 1 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr, count(CASE WHEN rank < 1 THEN 1 END) AS not_found FROM r""")
def recall_mrr(spark, sf):
    """The metrics' arithmetic, over made-up ranks: nothing is searched. recall_benchmark evaluates the engine."""
    return memory.metrics(_gold(spark, sf))


@query(f"""WITH n AS (SELECT doc_id, text, lang, [lang, source] AS tags FROM documents),
 q AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS terms FROM benchmark),
 w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS term, 1.0::DOUBLE AS w FROM n UNION ALL SELECT doc_id, unnest(regexp_split_to_array(lower(lang), '[^\\p{{L}}\\p{{N}}]+')), 0.4::DOUBLE FROM n
  UNION ALL SELECT doc_id, unnest(regexp_split_to_array(lower(lang), '[^\\p{{L}}\\p{{N}}]+')), 0.2::DOUBLE FROM n UNION ALL SELECT doc_id, unnest(regexp_split_to_array(lower(array_to_string(tags, ' ')), '[^\\p{{L}}\\p{{N}}]+')), 0.1::DOUBLE FROM n),
 p AS (SELECT doc_id, term, sum(w) AS w FROM w GROUP BY ALL), t AS (SELECT item_id, len(terms) AS terms, unnest(terms) AS term FROM q),
 s AS (SELECT item_id, doc_id, round(sum(w), 6) AS score FROM t JOIN p USING (term) GROUP BY item_id, doc_id, terms HAVING count(*) = terms),
 h AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS position FROM s),
 r AS (SELECT coalesce(position, -1) AS rank FROM (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON length(b.text) > 0 AND contains(d.text, b.text)) LEFT JOIN (SELECT * FROM h WHERE position <= 10) USING (item_id, doc_id))
 SELECT count(*) AS queries, {', '.join(f"round(coalesce(avg(CASE WHEN rank BETWEEN 1 AND {k} THEN 1.0::DOUBLE ELSE 0 END), 0), 6) AS recall_{k}" for k in (1, 3, 5, 10))}, round(coalesce(avg(CASE WHEN rank >= 1 THEN 1.0::DOUBLE / rank ELSE 0 END), 0), 6) AS mrr, count(CASE WHEN rank < 1 THEN 1 END) AS not_found FROM r""")
def recall_benchmark(spark, sf):
    """The engine's recall: gold are the pairs of a benchmark text and a document that holds it, hits the lexical stream's first ten of every benchmark text over all documents."""
    notes = a.raw_notes(spark, sf)
    asked = a.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = lexical.top_k_many(notes, asked, 10).withColumnRenamed("rank", "position")
    return memory.metrics(memory.gold_ranks(memory.contained(asked, notes), hits))


@query(f"WITH {V_NOTES}, {V_EDGES} SELECT (SELECT count(*) FROM conversations) AS episodes, (SELECT count(*) FROM active) AS active_notes, (SELECT count(*) FROM notes WHERE superseded_at IS NOT NULL) AS superseded_notes, (SELECT count(*) FROM entities) AS entities")
def project_summary(spark, sf):
    n = a.notes(spark, sf).agg(F.count_if(F.col("superseded_at").isNull()).alias("active_notes"), F.count("superseded_at").alias("superseded_notes"))
    one = lambda df, name: F.broadcast(df.agg(F.count("*").alias(name)))
    return n.join(one(a.read(spark, sf, "conversations"), "episodes")).join(one(a.entities(spark, sf), "entities")).select("episodes", "active_notes", "superseded_notes", "entities")


@query(f"""WITH {V_NOTES}, d AS (SELECT CAST(unnest(range(DATE '2024-01-06', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS day) SELECT strftime(day, '%Y-%m-%d') AS day, count(note_id) AS n FROM d LEFT JOIN notes ON CAST(created_at AS DATE) = day GROUP BY 1""")
def notes_per_day(spark, sf):
    return memory.per_day(a.raw_notes(spark, sf), "created_at", "2024-02-04 12:00:00").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


@query("SELECT list_extract(['General', 'Observation', 'Decision', 'Learning', 'Error', 'Pattern'], CAST(doc_id % 6 AS INT) + 1) AS kind, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM documents), 2) AS percent FROM documents GROUP BY 1")
def kind_counts(spark, sf):
    return memory.kind_counts(a.raw_notes(spark, sf))


@query(f"WITH {V_EDGES} SELECT count(*) - count(invalidated_at) AS active, count(invalidated_at) AS invalidated FROM edges")
def edge_state_counts(spark, sf):
    return memory.edge_states(a.edges(spark, sf))


@query(f"WITH {V_NOTES}, {V_EDGES} SELECT 'notes' AS relation, count(*) AS rows, count(*) - count(superseded_at) AS active FROM notes UNION ALL SELECT 'edges', count(*), count(*) - count(invalidated_at) FROM edges UNION ALL SELECT 'entities', count(*), count(*) FROM entities")
def backup_manifest(spark, sf):
    from notegraph.storage import shared_dir

    relations = {"notes": a.notes(spark, sf).select("note_id", "superseded_at"), "edges": a.edges(spark, sf).select("from_id", "to_id", "relation", "invalidated_at"), "entities": a.entities(spark, sf)}
    return connectors.backup(relations, f"{shared_dir(spark)}/notegraph/backup-{uuid.uuid4().hex}")


@query(f"WITH {V_NOTES} SELECT note_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM notes ORDER BY notes.created_at DESC, note_id DESC LIMIT 50")
def recent_list(spark, sf):
    return memory.newest(a.raw_notes(spark, sf), "created_at", "note_id", 0, "notes").select("note_id", _stamp("created_at"))


@query(f"WITH {V_EDGES} SELECT from_id, relation, to_id FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY relation, to_id) AS n FROM edges) WHERE n <= 3")
def edges_per_entity(spark, sf):
    place = F.row_number().over(Window.partitionBy("from_id").orderBy("relation", "to_id"))
    return a.edges(spark, sf).withColumn("n", place).filter("n <= 3").select("from_id", "relation", "to_id")


# --- tenancy -----------------------------------------------------------------------------------


def _catalog(spark, sf, scope=None):
    return ScopedCatalog(spark, {"notes": a.raw_notes(spark, sf)}, scope)


@query("SELECT source AS project_id, count(*) AS n FROM documents WHERE source = 'src3' GROUP BY 1")
def scope_isolation(spark, sf):
    return _catalog(spark, sf, Scope("o", "u", "src3")).table("notes").groupBy("project_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS note_id FROM documents WHERE FALSE")
def scope_missing(spark, sf):
    return _catalog(spark, sf).table("notes").select("note_id")


@query("""SELECT c_custkey AS token_id, CASE WHEN c_custkey % 4 = 0 OR c_custkey % 4 = 1 THEN 401 ELSE 200 END AS status, sha256('tok-' || c_custkey) AS hash FROM customer""")
def key_resolution(spark, sf):
    return _resolved(a.read(spark, sf, "customer"))


def _resolved(c):
    tokens = c.select(F.col("c_custkey").alias("token_id"), F.concat(F.lit("tok-"), "c_custkey").alias("token"))
    keys = tokens.filter("token_id % 4 <> 0").select(f.key_hash(F.col("token")).alias("key_hash"), F.when(F.col("token_id") % 4 == 1, F.to_timestamp(F.lit(NOW))).alias("revoked_at"))
    return resolve_keys(tokens, keys).select("token_id", "status", "hash")


@query("""SELECT c_custkey AS token_id, CASE WHEN c_custkey % 4 = 0 OR c_custkey % 4 = 1 THEN 401 ELSE 200 END AS status, sha256('tok-' || c_custkey) AS hash FROM customer""")
def key_resolution_all(spark, sf):
    return _resolved(a.read(spark, sf, "customer"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 401 WHEN c_custkey % 3 = 1 THEN 403 ELSE 200 END AS status FROM customer")
def admin_check(spark, sf):
    return _gated(a.read(spark, sf, "customer"))


def _gated(c):
    k = F.col("c_custkey") % 3
    return c.select(F.col("c_custkey").alias("id"), admin_gate(k != 0, k == 2).alias("status"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 401 WHEN c_custkey % 3 = 1 THEN 403 ELSE 200 END AS status FROM customer")
def admin_check_all(spark, sf):
    return _gated(a.read(spark, sf, "customer"))


# --- functions and connectors ------------------------------------------------------------------

_SLUG = "CASE WHEN s = '' THEN 'note' ELSE s END"
_SLUGS = r"""regexp_replace(regexp_replace(regexp_replace(lower(substring(text, 1, 40)), '[^\p{L}\p{Nd} _-]', '', 'g'), '[ _-]+', '-', 'g'), '^-+|-+$', '', 'g')"""


@query(rf"SELECT doc_id, {_SLUG} AS slug FROM (SELECT doc_id, {_SLUGS} AS s FROM documents)")
def slugify(spark, sf):
    return a.read(spark, sf, "documents").select("doc_id", f.slug(F.col("text")).alias("slug"))


@query(rf"""SELECT doc_id AS note_id, strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INT)), '%Y-%m-%d') || '_' || lower(list_extract(['General', 'Observation', 'Decision', 'Learning', 'Error', 'Pattern'], CAST(doc_id % 6 AS INT) + 1)) || '_' || {_SLUG} || '_' || substring(CAST(doc_id AS VARCHAR), 1, 8) || '.md' AS file,
 '---' || chr(10) || 'id: ' || doc_id || chr(10) || 'kind: ' || list_extract(['General', 'Observation', 'Decision', 'Learning', 'Error', 'Pattern'], CAST(doc_id % 6 AS INT) + 1) || chr(10) || 'created: ' || strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INT)), '%Y-%m-%dT%H:%M:%S') || chr(10) || 'tags: [' || lang || ', ' || source || ']' || chr(10) || 'keywords: [' || lang || ']' || chr(10) || 'context: ' || lang || chr(10) || '---' || chr(10) || chr(10) || text AS text
 FROM (SELECT *, {_SLUGS} AS s FROM documents)""")
def markdown_render(spark, sf):
    return connectors.rendered_notes(a.raw_notes(spark, sf))


@query(r"SELECT doc_id, doc_id % 3 <> 0 AS has_header, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS body_chars FROM documents")
def frontmatter_split(spark, sf):
    d = a.read(spark, sf, "documents").withColumn("t", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("---\nkind: General\n---\n"), "text")))
    return d.select("doc_id", f.frontmatter(F.col("t")).isNotNull().alias("has_header"), F.char_length(f.body(F.col("t"))).cast("long").alias("body_chars"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'x' || event_id ELSE CASE WHEN event_id % 3 = 1 THEN '{"content": 5, "meta": {"content": "y"}}' ELSE 'plain ' || event_id END END AS content, CASE WHEN event_id % 10 IN (0, 7) THEN 400 ELSE 200 END AS status,
 CASE WHEN event_id % 3 = 0 THEN '{"content": "x' || event_id || '"}' END AS raw FROM events""")
def webhook_parse(spark, sf):
    i = F.col("event_id")
    body = F.when(i % 3 == 0, F.concat(F.lit('{"content": "x'), i.cast("string"), F.lit('"}'))).when(i % 3 == 1, '{"content": 5, "meta": {"content": "y"}}').otherwise(F.concat(F.lit("plain "), i.cast("string")))
    reqs = a.read(spark, sf, "events").select("event_id", F.when(i % 10 == 0, F.repeat(F.lit("n"), 65)).when(i % 10 == 7, "  ").otherwise("hook").alias("name"), body.alias("body"))
    return connectors.generic_webhook(reqs).select("event_id", "content", "status", F.col("metadata")["webhook_raw"].alias("raw"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'challenge' WHEN event_type IN ('click', 'error') AND event_id % 5 <> 1 THEN 'ingest' ELSE 'ignore' END AS action FROM events""")
def slack_filter(spark, sf):
    e, i = a.read(spark, sf, "events"), F.col("event_id")
    kind = F.when(F.col("event_type") == "click", "message").when(F.col("event_type") == "error", "app_mention").otherwise(F.col("event_type"))
    event = F.struct(kind.alias("type"), F.when(i % 5 == 1, "  ").otherwise("hello").alias("text"), F.lit("c").alias("channel"), F.lit("u").alias("user"))
    body = F.when(i % 5 == 0, '{"type": "url_verification", "challenge": "q"}').otherwise(F.to_json(F.struct(F.lit("event_callback").alias("type"), event.alias("event"))))
    return connectors.slack_events(e.select("event_id", body.alias("body"))).select("event_id", "action")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_map_coerce(spark, sf):
    return a.read(spark, sf, "events").select("event_id", f.string_map(F.col("props"))["k"].alias("k"))


@query("SELECT string_agg('[' || position || '] ' || text, chr(10) ORDER BY position) AS context FROM (SELECT text, row_number() OVER (ORDER BY n_chars, doc_id) AS position FROM documents) WHERE position <= 5")
def context_builder(spark, sf):
    hits = vector.ranked(a.read(spark, sf, "documents").orderBy("n_chars", "doc_id").limit(5), "n_chars", "doc_id")
    return context_block(hits.select(F.col("rank").alias("position"), F.col("text").alias("content")))


@query("SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 3.8::DOUBLE)) END AS BIGINT) AS tokens, CASE WHEN length(text) > 120 THEN substring(text, 1, 120) || '…' ELSE text END AS preview, CAST(len(list_filter(regexp_split_to_array(text, '[ \n\t\r]+'), lambda w: w <> '')) AS INT) AS words FROM documents")
def scalar_functions(spark, sf):
    return a.read(spark, sf, "documents").select("doc_id", f.token_estimate(F.col("text")).alias("tokens"), f.truncated(F.col("text"), 120).alias("preview"), f.word_count(F.col("text")).alias("words"))


# --- events ------------------------------------------------------------------------------------


@query("""SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def events_window(spark, sf):
    e = a.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(_stamp("w.start", "start"), "event_type", "n", "total")


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 12 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS new FROM events),
 y AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM y GROUP BY user_id, s""")
def events_session(spark, sf):
    e = a.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.session_window("ts", "12 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", _stamp("w.start", "start"), "n")


@query()
def streaming_windows(spark, sf):
    """The windows of events_window, by a stream that runs to the end of what is there."""
    from notegraph.storage import shared_dir
    from notegraph.streaming import streams

    where = f"{shared_dir(spark)}/notegraph/stream-{uuid.uuid4().hex}"
    found = streams.windowed(streams.event_stream(spark, f"{sf}/events.parquet*"), late="400 days").select(_stamp("w.start", "start"), "event_type", "n", _r("total", 2))
    deliver = found.writeStream.outputMode("update").foreachBatch(lambda df, i: df.write.mode("append").parquet(f"{where}/out")).option("checkpointLocation", f"{where}/check").trigger(availableNow=True).start()
    deliver.awaitTermination()
    out = spark.read.parquet(f"{where}/out")
    return out.groupBy("start", "event_type").agg(F.max_by("total", "n").alias("total"), F.max("n").alias("n"))
