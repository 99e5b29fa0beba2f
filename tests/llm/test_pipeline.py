"""The pipeline's stages on the smallest tables, against what each operator says of the stage's own input."""

import corpus_pipeline
from notegraph.llm import jaccard


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        assert docs.filter("n_chars <> char_length(text)").count() == 0
        if name == "near_copies":
            assert jaccard.join(docs).filter("component_id <> doc_id").count() == 0
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] == sizes[4]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == sizes[4]


def test_edge_rows(spark, sf):
    rows = [(None, None, None, None, None, "x"), (1, "", "en", "s", 0, "x"), (2, "a b c d e f", "en", "s", 11, "x"), (2, "a b c d e f", "en", "s", 11, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra"] and docs.count() == 4


def test_clashing_columns(spark, sf):
    """Columns named as the operators name theirs, or with a dot, pass every stage as they are."""
    names = ["doc_id", "text", "lang", "source", "n_chars", "gone", "a.b", "quality_score", "n_dropped", "key", "row", "k"]
    rows = [(i, f"words of document {w} alone that no other has", "en", "s", 1, *(f"{i}{n}" for n in names[5:])) for i, w in enumerate(["one", "two", "three words", "of four words"])]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == names, name
        for r in docs.collect():
            assert tuple(r)[5:] == rows[r["doc_id"]][5:], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()
