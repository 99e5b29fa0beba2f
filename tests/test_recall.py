"""The evaluation against brute force: gold by containment, hits by a real ranked stream."""

import ast
import inspect

import bench
from notegraph.operators import lexical, memory
from notegraph.queries import QUERIES


def table(spark, tmp_path, rows, benchmark):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_many_queries_rank_as_one(spark, sf):
    notes = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id as note_id", "text as content", "lang as context")
    texts = {1: "the and of", 2: "The, the OF", 3: "en", 4: "no such zzzz words", 5: " ... "}
    asked = spark.createDataFrame(list(texts.items()), "query_id long, text string")
    got = {tuple(r) for r in lexical.top_k_many(notes, asked, 7).select("query_id", "note_id", "score", "rank").collect()}
    words = {1: ["the", "and", "of"], 2: ["the", "of"], 3: ["en"], 4: "no such zzzz words".split()}
    want = {(q, *r) for q, w in words.items() for r in lexical.top_k(notes, w, 7).select("note_id", "score", "rank").collect()}
    assert got == want and {q for q, *_ in got} == {1, 2, 3}


def test_contained(spark):
    notes = spark.createDataFrame([(1, "a b c"), (2, "xa b"), (3, None), (4, "A b")], "note_id long, content string")
    asked = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "q")], "query_id long, text string")
    assert {tuple(r) for r in memory.contained(asked, notes).collect()} == {(1, 1), (1, 2)}


def test_contained_is_what_a_scan_finds(spark):
    """Texts cut out of notes anywhere, also within words and at double spaces, of one piece and of many."""
    import random

    rng = random.Random(1)
    notes = [(i, "".join(rng.choice(["ab ", "a ", "ba", " ", "c d ", "ab\n"]) for _ in range(rng.randrange(0, 60)))) for i in range(80)] + [(90, None), (91, "")]
    texts = []
    for i in range(150):
        whole = rng.choice(notes)[1] or "ab"
        at = rng.randrange(0, len(whole) + 1)
        texts.append((i, whole[at : at + rng.randrange(1, 30)] + ("x" if i % 10 == 0 else "")))
    texts += [(200, None), (201, "")]
    got = memory.contained(spark.createDataFrame(texts, "query_id long, text string"), spark.createDataFrame(notes, "note_id long, content string")).collect()
    want = {(q, n) for q, t in texts for n, c in notes if t and c is not None and t in c}
    assert {tuple(r) for r in got} == want and len(got) == len(want) and len(want) > 300


def test_recall_follows_the_documents(spark, tmp_path):
    """Item 1 stands in 10 and, deeper in its words' rank, in 11; item 2 in 12, cut in a word that no term matches; item 3 nowhere."""
    rows = [(10, "red green blue red green blue"), (11, "red green blue"), (12, "xalpha beta"), (13, "blue green red red red red"), (14, None)]
    sf = table(spark, tmp_path, rows, [(1, "red green blue"), (2, "alpha beta"), (3, "never said")])
    got = QUERIES["recall_benchmark"](spark, sf).first().asDict()
    # item 1's ranks by summed counts, ties by id: 10 and 13 have six words each, 11 three
    assert got == {"queries": 3, "recall_1": 0.333333, "recall_3": 0.666667, "recall_5": 0.666667, "recall_10": 0.666667, "mrr": round((1 + 1 / 3) / 3, 6), "not_found": 1}


def test_bench_reports_the_engine():
    text = inspect.getsource(bench)
    assert 'quality = found["recall_benchmark"]' in text and ast.parse(text)
