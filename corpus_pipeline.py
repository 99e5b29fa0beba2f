"""Corpus pipeline: documents to packed sequences.

Stages, in order: documents of low quality go; lines whose templates recur go; of each component of near copies (five
words, similarity 0.8) the first document stays; secrets are masked; what is left is packed. Each stage but the last
returns the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.llm import jaccard, lines, packing, quality, secrets
from notegraph.llm.common import stored, table

LEAST_QUALITY = 0.3


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, if it has that column, as the text's; null where the text is."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score under LEAST_QUALITY; labels of the held-out fifth are not learned. Without labels all stay."""
    labels = table(spark, sf_dir, "labels").filter(~quality.held_out(F.col("doc_id")))
    whole = docs.select(F.struct("*").alias("row"), "text")
    scored = quality.score(whole, quality.train(docs, labels))
    return scored.filter(F.col("quality_score") >= LEAST_QUALITY).select("row.*")


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines of recurring templates out of all documents but the first with each. All documents stay."""
    return _counted(lines.drop_recurring(docs, dropped_col=None))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each component of near copies."""
    return jaccard.drop_near_copies(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks found secrets in the texts. All documents stay."""
    return _counted(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that are left."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("lines", drop_recurring_lines),
    ("near_copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: SQL can express neither a trained classifier nor a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
