"""Line dedup by log templates.

Lines are parsed down a tree of fixed depth: by their number of tokens, then by their leading tokens, where a
token with a digit counts as variable. In a leaf, lines join the template most like them, whose differing
positions are variable. Templates that recur across documents are dropped.

Only lines that agree in some stretch of tokens (a band) can be like enough, so a leaf falls apart into components of
lines that share bands, and each is parsed on its own, in two rounds: first in PARTS parts, then the parts' founding lines together. No leaf
has to fit one task as a whole, and small and large ones are parsed alike.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.llm.common import forget, let, met_with, quoted, release, small_batches, stored
from notegraph.llm.graph import components

VARIABLE = b"<*>"
#: Leading tokens that the tree descends by, the least tokens of a line that can be dropped, the texts in which a template recurs, and the parts of the first round.
DEPTH, MIN_TOKENS, MIN_DOCS, SIMILAR, PARTS = 3, 1, 2, 0.8, 64
#: A token with a digit is variable.
DIGIT = re.compile(rb"[0-9]")


def tokens_of(line: bytes) -> list[bytes]:
    """A line's tokens, cut at ASCII white space, those with a digit as variable; a blank line has none."""
    tokens = line.split()
    return [VARIABLE if DIGIT.search(t) else t for t in tokens] if DIGIT.search(line) else tokens


def differing(n: int, similar: float) -> int:
    """Positions in which two lines of n tokens may differ."""
    return n - math.ceil(similar * n - 1e-9)


def bands(tokens: list[bytes], similar: float, depth: int) -> list[int]:
    """Hashes of the stretches of a line: tokens past the leading ones, cut into one stretch more than may differ, so lines of a leaf that are like enough share one."""
    rest, n = tokens[depth:], differing(len(tokens), similar) + 1
    return [xxhash.xxh3_64_intdigest(b" ".join(rest[len(rest) * i // n : len(rest) * (i + 1) // n]), seed=i) for i in range(n)]


def lines_of(docs: DataFrame, id_col: str, text_col: str, min_tokens: int, depth: int, similar: float) -> DataFrame:
    """(doc_id, key, copy, at, leaf, line, tokens) of the lines that are long enough and not variable throughout.

    copy is the text's hash, key that of id and text; line that of the tokens, leaf that of their number and the
    leading ones. Of lines that no other can be like without being equal, the leaf is the line's and the tokens are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            of, at, leaf, line, shown = [], [], [], [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                for place, raw in enumerate(text.split(b"\n") if text else ()):
                    tokens = tokens_of(raw)
                    n = len(tokens)
                    if n < min_tokens or not n or tokens.count(VARIABLE) == n:
                        continue
                    joined = b" ".join(tokens)
                    h = digest(joined)
                    alone = n <= depth or not differing(n, similar)
                    of.append(i)
                    at.append(place)
                    line.append(h)
                    leaf.append(h if alone else digest(b" ".join(tokens[:depth]), seed=n))
                    shown.append(None if alone else joined)
            where = pa.array(of, pa.int64())
            hashes = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (leaf, line))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(where) for c in range(3)), pa.array(at, pa.int32()), *hashes, pa.array(shown, pa.binary())], names)

    names = ["doc_id", "key", "copy", "at", "leaf", "line", "tokens"]
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.xxhash64(text).alias("copy"), text.cast("binary").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "copy").alias("key"), "copy", "text")
    return rows.mapInArrow(run, "doc_id long, key long, copy long, at int, leaf long, line long, tokens binary")


class Leaf:
    """The templates of lines of one leaf. A line joins that template whose founding line agrees with it in most tokens (the earlier, of equals), if in a share of similar or more. Only founders that share a band with it are compared, and they are held as bytes."""

    def __init__(self, similar: float, depth: int):
        self.similar, self.depth = similar, depth
        self.founders: list[bytes] = []
        self.index: dict[int, list[int]] = {}

    def add(self, tokens: list[bytes]) -> int:
        """The number of the template that the line joins or founds."""
        found = bands(tokens, self.similar, self.depth)
        best, at = 0, -1
        for i in sorted({i for b in found for i in self.index.get(b, ())}):
            same = sum(map(bytes.__eq__, self.founders[i].split(b" "), tokens))
            if same > best:
                best, at = same, i
        if at >= 0 and best >= self.similar * len(tokens) - 1e-9:
            return at
        self.founders.append(b" ".join(tokens))
        for b in found:
            self.index.setdefault(b, []).append(len(self.founders) - 1)
        return len(self.founders) - 1


def _parsed(lines: DataFrame, similar: float, depth: int) -> DataFrame:
    """rows (unit, part, leaf, line, docs, tokens) with the founder of the template that the line joins, as its line; a task holds one (unit, part, leaf) at a time. Lines of most texts come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaf, founders = None, None, []
        for batch in batches:
            out = []
            for *key, line, tokens in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 3, 5)), strict=True):
                if leaf is None or key != now:
                    now, leaf, founders = key, Leaf(similar, depth), []
                n = leaf.add(tokens.split(b" "))
                if n == len(founders):
                    founders.append(line)
                out.append(founders[n])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "founder"])

    keys = ("unit", "part", "leaf")
    dealt = lines.select(*keys, "line", "docs", "tokens").repartition(*keys).sortWithinPartitions(*keys, F.desc("docs"), "line")
    return dealt.mapInArrow(run, "unit long, part int, leaf long, line long, docs long, tokens binary, founder long")


def _units(lines: DataFrame, similar: float, depth: int) -> DataFrame:
    """(node, component) of the nodes (hashes of leaf and line) that share a band with another line of their leaf, directly or by others between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bands(t.split(b" "), similar, depth) for t in batch.column(2).to_pylist()]
            where = np.repeat(np.arange(len(found)), [len(x) for x in found])
            hashes = pa.array(np.array([b for x in found for b in x], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where)), batch.column(1).take(pa.array(where)), hashes], ["node", "leaf", "band"])

    shared = lines.select("node", "leaf", "tokens").mapInArrow(run, "node long, leaf long, band long").select("node", F.xxhash64("leaf", "band").alias("band"))
    shared = stored(shared, "bands")
    least = shared.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most").select("band", "least")
    found = components(shared.join(least, "band").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")))
    forget(shared)
    return found


def recurring(placed: DataFrame, *, min_docs: int = MIN_DOCS, depth: int = DEPTH, similar: float = SIMILAR) -> DataFrame:
    """(leaf, line, first) of the distinct lines of lines_of() whose templates recur in min_docs different texts or more: first is the least id with the template.

    Exact copies of a text count as one, so that copies alone don't make a text's lines recur. Lines that no
    other of their leaf is like are templates of their own and take no part in the parse.
    """
    met = stored(placed.groupBy("leaf", "line", "copy").agg(F.min("doc_id").alias("id")), "lines")
    by_line = stored(met.groupBy("leaf", "line").agg(F.count("*").alias("docs"), F.min("id").alias("first")), "by_line")
    open_ = stored(by_line.groupBy("leaf").agg(F.count("*").alias("n")).filter("n > 1").select("leaf"), "leaves")
    texts = met_with(placed.select("leaf", "line", "tokens"), open_, ["leaf"]).groupBy("leaf", "line").agg(F.first("tokens").alias("tokens"))
    texts = stored(texts.join(by_line.drop("first"), ["leaf", "line"]).withColumn("node", F.xxhash64("leaf", "line")), "open")
    units = _units(texts, similar, depth)
    first_round = texts.join(units, "node").select(F.col("component").alias("unit"), F.pmod(F.xxhash64("line"), F.lit(PARTS)).cast("int").alias("part"), "leaf", "line", "docs", "tokens")
    one = stored(_parsed(first_round, similar, depth), "parsed")
    two = _parsed(one.filter("line = founder").withColumn("part", F.lit(-1)), similar, depth).select("leaf", F.col("line").alias("founder"), F.col("founder").alias("template"))
    of = stored(one.select("leaf", "line", "founder").join(two, ["leaf", "founder"]).select("leaf", "line", "template"), "templates")
    by_text = met.join(of, ["leaf", "line"]).groupBy("leaf", "template", "copy").agg(F.min("id").alias("id"))
    counts = by_text.groupBy("leaf", "template").agg(F.count("*").alias("texts"), F.min("id").alias("first")).filter(F.col("texts") >= min_docs)
    parsed = of.join(counts, ["leaf", "template"]).select("leaf", "line", "first")
    alone = by_line.filter(F.col("docs") >= min_docs).join(of, ["leaf", "line"], "left_anti").select("leaf", "line", "first")
    found = stored(parsed.unionByName(alone), "recurring")
    for used in (met, by_line, open_, texts, one, of):
        forget(used)
    return found


def drop_recurring(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, depth: int = DEPTH, similar: float = SIMILAR, dropped_col: str | None = "n_dropped") -> DataFrame:
    """docs with recurring lines taken out of text_col, and their number in dropped_col, if that is given.

    The document of least id that has a template keeps its lines, so every text is left once. Blank lines, lines of fewer than min_tokens
    tokens and lines of variable tokens alone always stay. A null text stays null and an empty one empty; a document all of whose lines go keeps an empty text. Rows without an id
    lose lines whose templates have a first document, and keep the others. Rows, other columns, whatever their names, and
    nulls in them stay; a column dropped_col is replaced. No rows: none.
    """
    small_batches(docs.sparkSession)
    placed = stored(lines_of(docs, id_col, text_col, min_tokens, depth, similar), "placed", compression="zstd")
    gone = recurring(placed, min_docs=min_docs, depth=depth, similar=similar)
    hits = met_with(placed.select("key", "doc_id", "at", "leaf", "line"), gone, ["leaf", "line"]).filter(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("doc_id")))
    marks = stored(hits.groupBy(F.col("key").alias("k")).agg(F.collect_set("at").alias("ats")), "marks")
    forget(placed)
    forget(gone)
    release(docs.sparkSession)
    if dropped_col:
        docs = docs.drop(quoted(dropped_col))
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    whole = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col(quoted(id_col)).cast("long"), F.xxhash64(text)).alias("key"))
    # Texts are always dealt by key and never sorted, so that what moves is in proportion to the input at any size.
    joined = whole.join(marks.hint("shuffle_hash"), F.col("key") == F.col("k"), "left")
    old = F.col(f"row.{quoted(text_col)}")
    kept = let(F.split(old, "\n", -1), lambda parts: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("ats")), lambda i: F.get(parts, i)), "\n"))
    row = F.col("row").withField(quoted(text_col), F.when(F.col("ats").isNull(), old).otherwise(kept))
    out = joined.select(row.alias("row"), F.coalesce(F.size("ats"), F.lit(0)).alias("n"))
    return out.select("row.*", F.col("n").alias(dropped_col)) if dropped_col else out.select("row.*")
