"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases (LZ78: each phrase is the longest one seen before and one more
character), the set of phrases is hashed, and the least hash values in each of 128 classes form the
fingerprint. The share of classes in which two fingerprints agree estimates the Jaccard similarity of their
phrase sets, which is high for texts that compress well together.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.llm.common import small_batches

CLASSES = 128
EMPTY = np.uint32(0xFFFFFFFF)


def phrases(text: str) -> set[str]:
    """The LZ78 phrases of text; a last, unfinished one is among them already."""
    seen: set[str] = set()
    add, held = seen.add, ""
    for c in text:
        held += c
        if held not in seen:
            add(held)
            held = ""
    return seen


def signature(found: set[str]) -> np.ndarray:
    """One-permutation minimum hashes: each phrase's hash falls in a class by its low bits, and the least of its high bits counts. An empty class takes the next filled one's value, with its distance mixed in."""
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(p) for p in found), np.uint64, len(found))
    out = np.full(CLASSES, EMPTY)
    if len(h):
        kind, value = (h % np.uint64(CLASSES)).astype(np.int64), (h >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((value, kind))
        kind, value = kind[order], value[order]
        first = np.flatnonzero(np.diff(kind, prepend=-1))
        out[kind[first]] = value[first]
        filled = kind[first]
        if len(filled) < CLASSES:
            at = np.arange(CLASSES)
            place = np.searchsorted(filled, at)
            nearest = filled[place % len(filled)]
            away = ((nearest - at) % CLASSES).astype(np.uint32)
            out = out[nearest] ^ (away * np.uint32(0x9E3779B1))
    return out


def shown(sig: np.ndarray) -> str:
    return sig.astype("<u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id and its fingerprint. No shuffle. Null text: that of an empty one; equal texts have equal fingerprints."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shown(signature(phrases(t or ""))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def _slice_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds lie below key, by binary search in a literal."""
    steps = [1 << i for i in reversed(range(max(1, len(bounds).bit_length())))]
    array = F.from_json(F.lit(json.dumps({"a": bounds})), "a array<bigint>")["a"]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.get(array, at + s - 1) < key), at + s).otherwise(at))


def ring(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows_per_slice: int = 200, most_slices: int = 10_000) -> DataFrame:
    """Rows (slice, head, doc_id, text), where each slice of ids holds its rows and, with head set, the one that follows its last in descending order; the one after the last row is the first.

    Slices are ranges of ids of near equal counts, most_slices at most. Only slice bounds and heads' ids (one per slice) pass through the driver.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"))
    n = min(max(1, ids.count() // rows_per_slice), most_slices)
    bounds = ids.select(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], min(100_000, 100 * n)).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    at = _slice_of(F.coalesce("doc_id", F.lit(-(2**63))), bounds)
    cut = rows.withColumn("slice", at)
    heads = ids.select(_slice_of(F.col("id"), bounds).alias("slice"), "id").groupBy("slice").agg(F.max("id").alias("id")).collect()
    order = sorted((r["slice"], r["id"]) for r in heads)  # each slice's first in descending order
    lower = {i: order[(k + 1) % len(order)][0] for k, (_, i) in enumerate(order)}  # a head follows the slice above; the topmost follows the lowest
    follows = F.from_json(F.lit(json.dumps({"a": [i for _, i in order]})), "a array<bigint>")["a"]
    above = F.from_json(F.lit(json.dumps({"a": [lower[i] for _, i in order]})), "a array<int>")["a"]
    place = F.array_position(follows, F.coalesce("doc_id", F.lit(-(2**63)))).cast("int")
    copies = cut.filter(place > 0).select(F.get(above, place - 1).alias("slice"), F.lit(True).alias("head"), "doc_id", "text")
    return cut.select("slice", F.lit(False).alias("head"), "doc_id", "text").unionByName(copies)


def compare_neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit, whose last floor(n/2) code points are replaced by the first as many (or all) of the next text by descending id (the last's next is the first).

    Rows of one id go by their texts, null ids come last; a single row is its own next. Null text: empty. No rows: none.
    Texts move once, to their slices; a task streams sorted rows and holds two of them.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the row whose next one has yet to come

        def row(slice_, doc_id, text, sig, nxt, next_sig):
            half = len(text) // 2
            edited = text[: len(text) - half] + nxt[:half]
            edited_sig = signature(phrases(edited))
            sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            return doc_id, len(text), sha, shown(sig), shown(edited_sig), likeness(sig, edited_sig), likeness(sig, next_sig)

        for batch in batches:
            out = []
            for slice_, head, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sig = signature(phrases(text))
                if before is not None and before[0] == slice_:
                    out.append(row(*before, text, sig))
                before = None if head else (slice_, doc_id, text, sig)
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 2, strict=True)], [x.split()[0] for x in RESULT.split(", ")])

    rows = ring(docs, id_col=id_col, text_col=text_col).repartition("slice")
    return rows.sortWithinPartitions("slice", "head", F.desc_nulls_last("doc_id"), "text").select("slice", "head", "doc_id", "text").mapInArrow(run, RESULT)
