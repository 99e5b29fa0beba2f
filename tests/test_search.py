"""The hybrid search over the whole memory."""

import pytest
from pyspark.sql import functions as F

from notegraph import queries
from notegraph.operators import fusion, graph
from notegraph.storage import bucketed


def test_four_streams(spark, sf):
    found = queries._whole_search(spark, sf)
    ranks = {s: [(r["note_id"], r["rank"]) for r in df.select("note_id", "rank").collect()] for s, df in found.streams.items()}
    assert list(ranks) == list(fusion.STREAMS) and all(ranks.values())
    score = {}
    for rows in ranks.values():
        for note, rank in rows:
            score[note] = score.get(note, 0) + 1 / (60 + rank)
    got = queries.QUERIES["hybrid_search_four"](spark, sf).orderBy("position").collect()
    assert got and all(abs(r["score"] - score[r["note_id"]]) < 1e-8 for r in got)
    assert abs(got[0]["score"] - max(score.values())) < 1e-8
    for r in got:
        assert r["from_graph"] == (r["note_id"] in dict(ranks["graph"])) and r["from_lexical"] == (r["note_id"] in dict(ranks["lexical"]))


def test_positional_rank(spark):
    """ts_rank by its formula, over the pairs of places of two terms."""
    import itertools
    import math

    from notegraph.operators import lexical

    texts = {1: ("big cat and big dog", "dog", []), 2: ("dog " + "x " * 200 + "cat", "", []), 3: ("cat dog", None, ["dog"]), 4: ("cat", "", []), 5: ("cat cat", "dog", None), 6: (None, None, None), 7: ("dog cat " * 400, "", [])}
    notes = spark.createDataFrame([(i, c, x, t) for i, (c, x, t) in texts.items()], "note_id long, content string, context string, tags array<string>")

    def places(i, term):
        at, out = 0, []
        for words, weight in zip(((texts[i][0] or "").split(), (texts[i][1] or "").split(), texts[i][2] or []), (1.0, 0.4, 0.1), strict=True):
            out += [(at + j, weight) for j, w in enumerate(words, 1) if w == term]
            at += len(words)
        return out[:255]

    def rank(i):
        left = 1.0
        for (p, v), (q, w) in itertools.product(places(i, "cat"), places(i, "dog")):
            if p != q:
                left *= 1 - math.sqrt(v * w * (1e-30 if abs(p - q) > 100 else 1 / (1.005 + 0.05 * math.exp(abs(p - q) / 1.5 - 2))))
        return round(1 - left, 6)

    got = lexical.top_k_positions(notes, ["cat", "dog", "cat"], 10).collect()
    want = sorted(((i, rank(i)) for i in (1, 2, 3, 5, 7)), key=lambda x: (-x[1], x[0]))
    assert [(r["note_id"], r["score"]) for r in got] == [(i, pytest.approx(s, abs=1e-6)) for i, s in want]
    (one,) = lexical.top_k_positions(notes.filter("note_id = 5"), ["cat"], 10).collect()
    assert one["score"] == pytest.approx((1 + 1 / 4) / 1.64493406685, abs=1e-6)
    assert lexical.top_k_positions(notes, [], 10).isEmpty() and lexical.top_k_positions(notes, ["nowhere"], 10).isEmpty()


def test_texts_are_cut_to_words_once(spark):
    """However many terms are asked for, and with the filter on what they score."""
    from notegraph.operators import lexical

    notes = spark.createDataFrame([(1, "The cat and the dog"), (2, "catalogue and dog"), (3, "dog")], "note_id long, content string")
    for rank in (lexical.top_k, lexical.top_k_positions):
        found = rank(notes, ["cat", "dog", "and"], 10)
        assert [r["note_id"] for r in found.collect()] == [1]
        assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_nearest_decides_copies_and_ties_exactly(spark):
    """Blocks multiplied by tiles in single precision give brute force's neighbours, and of a block's copies k + 1 alone are looked at."""
    import numpy as np

    from notegraph.operators import vector

    rng = np.random.default_rng(3)
    v = rng.normal(size=(1500, 16)).astype(np.float32)
    v[500:900] = v[7]
    v[1000] = 0
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "note_id long, embedding array<float>")
    got = {(r["source_id"], r["target_id"]) for r in vector.knn(rows, 3, block=400).collect()}
    with np.errstate(invalid="ignore"):
        u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    best = np.argsort(np.round(d, 12), axis=1, kind="stable")[:, :3]
    assert got == {(i, int(j)) for i in range(1500) if i != 1000 for j in best[i]}
    assert len(vector._first_copies(v, 3)) == 1500 - 401 + 4


def test_walk_stays_where_it_lies(spark, sf):
    """A join by the key of a bucketed table shuffles the other side alone, and PageRank's result is cut from its steps."""
    edges = spark.createDataFrame([("a", "b", None), ("b", "c", None), ("b", "c", None), ("d", "d", None)], "from_id string, to_id string, invalidated_at timestamp")
    rows = edges.selectExpr("from_id a", "to_id b")
    walk = bucketed(rows, "walk", "a")
    joined = walk.join(spark.createDataFrame([("b",)], "entity_id string").hint("shuffle_hash"), F.col("a") == F.col("entity_id"))
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(walk.collect()) == sorted(rows.collect())
    mass = graph.ppr(edges, spark.createDataFrame([("a",), ("z",)], "entity_id string"), steps=2)
    plan = mass._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    want = {"z": 0.5, "a": 0.075 + 0.5 * 0.85 * 0.85 / 3, "b": 0.075 * 0.85, "c": 0.5 * 0.85 * 0.85 * 2 / 3}
    assert {r["entity_id"]: round(r["mass"], 9) for r in mass.collect()} == {k: round(v, 9) for k, v in want.items()}


def test_streams_run_once(spark, sf):
    """Hits and decision read the fused streams, which are not run for each anew."""
    found = queries._whole_search(spark, sf)
    for df in (found.hits, found.decision):
        assert "embedding" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_without_a_direction_are_not_near(spark):
    """Words whose signs cancel give the zero vector, which has no distance; it came before all others."""
    from notegraph.operators import vector

    notes = spark.createDataFrame([(i,) for i in range(5)], "note_id long")
    held = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, None), (4, [-1.0, 0.0])], "note_id long, embedding array<float>")
    assert [(r["note_id"], r["rank"]) for r in vector.top_k(notes, held, [1.0, 0.0], 4).collect()] == [(2, 1), (1, 2), (4, 3)]
