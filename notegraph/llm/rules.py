"""Quality rules, in DataFrame functions only: counts of a text's words, symbols, repeated lines and windows, and a likelihood ratio.

Words and pairs of neighbouring words are hashed to BUCKETS. Two multinomials over the buckets are compared: one of trusted
documents, one of the whole corpus. A document's score is the mean log of their ratio over its grams; it is kept if that
reaches a threshold below which few trusted documents that took no part in the fit lie.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.llm.common import forget, let, quoted, sized, stored

#: Buckets of hashed grams, the width of a window, and parts of a nat in which a bucket's log ratio is held, so that sums are exact.
BUCKETS, WINDOW, UNIT = 1 << 16, 5, 10_000
#: The share of trusted documents that may lie below the threshold.
LOST = 0.0025

# White space between words, symbols, and the limits of the base rules.
SPACE = r"[\x20\x09-\x0D]+"
SPACES, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
LEAST_WORDS, REPEATED = 10, (100, 20)


@dataclass(frozen=True)
class Model:
    """ratios: of each bucket, the log of trusted to corpus probability in parts of UNIT. threshold: the least mean log ratio that is kept. Without trusted documents both are None and the ratio decides nothing."""

    ratios: list[int] | None
    threshold: float | None


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def without(text: Column, marks: str) -> Column:
    """Code points of text that are none of marks."""
    return F.char_length(F.translate(text, marks, "")).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier one."""
    return let(F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeated_words(words: Column) -> Column:
    """Words in windows of WINDOW words that stand twice or more. Windows are told apart by 64-bit hashes; sorted by them, alike ones are neighbours, so no pairs are compared."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))

    def places(hashes: Column) -> Column:
        alike = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(ordered, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: alike(s, x, j - 1) | alike(s, x, j + 1)), lambda x: x["i"])))

    def covered(at: Column) -> Column:
        """A window covers what it doesn't share with the next."""
        return F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, n: a + n)

    found = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(places(h), covered)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) > WINDOW, found).otherwise(F.lit(0).cast("long"))


def _bucket(*words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(BUCKETS)).cast("int")


def _pair(words: Column, word: Column, i: Column) -> Column:
    return _bucket(F.get(words, i - 1), word)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    return docs.select(F.struct("*").alias("row"), F.col(quoted(id_col)).cast("long").alias("id"), text.alias("t"))


def _mean(words: Column, ratios: list[int]) -> Column:
    """The mean log ratio over words and pairs, in nats; 0 without words."""
    table = F.from_json(F.lit(json.dumps(ratios, separators=(",", ":"))), "array<int>")  # folded to a literal when the plan is optimized
    at = lambda bucket: F.get(table, bucket)
    each = F.transform(words, lambda w, i: at(_bucket(w)) + F.when(i > 0, at(_pair(words, w, i))).otherwise(0))
    total = F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(F.size(words) > 0, total / ((2 * F.size(words) - 1) * F.lit(float(UNIT)))).otherwise(F.lit(0.0))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", lost: float = LOST) -> Model:
    """The corpus' multinomial from all documents, the trusted one from documents labelled 1, the threshold from others labelled 1.

    By the remainder of crc32(id as text) by 5, labels of 0 are never read, those of 1 set the threshold and the others are learned, all of
    them. An id with several labels counts by its least. Null ids and other labels are ignored. What reaches the driver is a count for each
    bucket and the two scores about the threshold; what is broadcast, the labelled ids, if they are few enough; otherwise texts are dealt by id, once all and once a fifth.
    """
    known = labels.filter(F.col(quoted(id_col)).isNotNull()).groupBy(F.col(quoted(id_col)).cast("long").alias("of")).agg(F.min(quoted(label_col)).alias("label")).filter("label = 1")
    part = F.crc32(F.col("of").cast("string")) % 5
    known = stored(known.filter(part > 0).select("of", F.when(part > 1, 1).otherwise(0).alias("learned")), "trusted")
    rows = _rows(docs, id_col, text_col).select("id", "t").join(sized(known), F.col("id") == F.col("of"), "left")
    grams = let(words_of(F.col("t")), lambda w: F.flatten(F.transform(w, lambda x, i: F.when(i > 0, F.array(_bucket(x), _pair(w, x, i))).otherwise(F.array(_bucket(x))))))
    counts = rows.select(F.coalesce("learned", F.lit(0)).alias("learned"), F.explode(grams).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("learned").alias("trusted")).collect()
    n, t = sum(r["n"] for r in counts), sum(r["trusted"] for r in counts)
    model = Model(None, None)
    if t:
        of = {r["bucket"]: (r["n"], r["trusted"]) for r in counts}
        log = lambda in_corpus, in_trusted: math.log((in_trusted + 1) / (t + BUCKETS)) - math.log((in_corpus + 1) / (n + BUCKETS))
        ratios = [round(UNIT * log(*of.get(b, (0, 0)))) for b in range(BUCKETS)]
        others = _rows(docs, id_col, text_col).select("id", "t").filter(F.crc32(F.col("id").cast("string")) % 5 == 1)
        scores = others.join(sized(known.filter("learned = 0")), F.col("id") == F.col("of")).select(_counted(F.col("t"), ratios).alias("c"))
        scores = stored(scores.select(F.when(~_failed(F.col("c.n_words"), F.col("c.n_repeat_words")), F.col("c.score")).alias("score")), "scores")  # a filter would count words twice
        model = Model(ratios, _share(scores.filter("score is not null"), lost))
        forget(scores)
    forget(known)
    return model


def _share(scores: DataFrame, lost: float) -> float | None:
    """The value below which a share lost of all scores lies, between the two next to it, exactly; null without scores. A task keeps its lowest ones alone, that share of all and two more at most."""
    n = scores.count()
    if not n:
        return None
    at = lost * (n - 1)
    low = math.floor(at)
    ends = [r["score"] for r in scores.orderBy("score").offset(low).limit(2).collect()]
    return ends[0] if at == low else (low + 1 - at) * ends[0] + (at - low) * ends[1]


def _failed(n_words: Column, n_repeat_words: Column) -> Column:
    share, most = REPEATED
    return (n_words < LEAST_WORDS) | (share * n_repeat_words > most * n_words)


def _counted(text: Column, ratios: list[int] | None) -> Column:
    """What is counted in a text's words, which are cut once: the optimizer may put a column's expression wherever it is read, but a lambda's variable stays bound."""
    score = lambda w: F.lit(0.0) if ratios is None else _mean(w, ratios)
    return let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"), score(w).alias("score")))


def _judged(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    t = F.col("t")
    counted = _rows(docs, id_col, text_col).select(
        "row", "id", _counted(t, model.ratios).alias("c"), without(t, SPACES).alias("word_chars"), (F.char_length(t) - without(t, SYMBOLS)).cast("long").alias("n_symbols"), repeated_lines(t).alias("n_dup_lines"),
    )
    held = counted.select("row", "id", "c.*", "word_chars", "n_symbols", "n_dup_lines").withColumn("base_failed", _failed(F.col("n_words"), F.col("n_repeat_words")))
    fine = F.lit(True) if model.threshold is None else F.col("score") >= F.lit(model.threshold)
    return held.withColumn("kept", ~F.col("base_failed") & fine)


def judge(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score (the mean log ratio, in nats) and kept. No shuffle.

    A null text is an empty one: no words, so it fails the base rules. A null id stays null. Repeated rows are judged each, alike. Whole texts are read,
    whatever their length. Rows without a word score 0. No rows: none.
    """
    return _judged(docs, model, id_col, text_col).select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def keep(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all columns, whatever their names, without the documents that judge() does not keep."""
    return _judged(docs, model, id_col, text_col).filter("kept").select("row.*")
