"""Filter interaction audit: what each filter removes in every order of the filters, and what each alone is responsible for.

Exact duplicates, one of the filters, are found by partition refinement: documents are split by their length, then by the
hashes of successive blocks, and singletons drop after each split. The texts that survive are compared whole. Each
document is then a mask of the filters that it fails, and every order's figures follow from the counts of masks.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.llm.common import forget, quoted, stored

#: Code points at which blocks end; the last block takes the rest.
BLOCK_ENDS = (64, 512, 4096)
#: Survivors' keys are brought to the texts by so many residues at most, whatever the corpus' size.
RESIDUES = 1 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A filter's letter, and the condition of a document that it removes, on the text and its words.
RULES: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 50,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
    "C": lambda text, words: 100 * (F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))) > 5 * F.char_length(text),
    "D": lambda text, words: text.rlike(r"[#$%&*|]"),
}
DUPLICATES = "E"


def _levels(text: Column, seed: int) -> list[Column]:
    """The length, and after it a hash for each block over the one before and the block."""
    ends = [0, *BLOCK_ENDS]
    found = [F.char_length(text).cast("long")]
    for start, end in zip(ends, [*ends[1:], None], strict=True):
        block = F.substr(text, F.lit(start + 1), *([F.lit(end - start)] if end else []))
        found.append(F.xxhash64(F.lit(seed), found[-1], block))
    return found


def _refined(rows: DataFrame, levels: list[str]) -> DataFrame:
    """Those rows that are no singleton at any level; each split looks at what the one before has left."""
    for at in levels:
        shared = stored(rows.groupBy(at).agg(F.count("*").alias("n")).filter("n > 1").select(at), "shared")
        left = stored(rows.join(shared, at, "left_semi"), "refined")
        forget(shared)
        if at != levels[0]:
            forget(rows)
        rows = left
    return rows


def first_copies(docs: DataFrame, facts: DataFrame, seed: int) -> DataFrame | None:
    """(key, first) of the texts that stand more than once: key is their last hash, first their least id. None where texts of one key differ.

    docs: id and t, the whole text. facts: id and the levels g0, g1, ..., the last of which is the key. Of the texts only
    survivors' ones are grouped, each task's copies as one; residues of keys, a bounded set, tell which those are.
    """
    levels = [c for c in facts.columns if c[0] == "g" and c[1:].isdigit()]
    key = levels[-1]
    left = _refined(facts.select(*levels), levels)
    residue = F.pmod(F.col(key), F.lit(RESIDUES))
    there = stored(left.select(residue.cast("int").alias("r")).distinct(), "residues")  # RESIDUES rows at most
    forget(left)
    whole = docs.select("id", "t", _levels(F.col("t"), seed)[-1].alias(key)).withColumn("r", residue.cast("int"))
    texts = whole.join(F.broadcast(there), "r", "left_semi").groupBy(key, "t").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1")
    found = stored(texts.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("texts"), F.min("first").alias("first")), "copies")
    forget(there)
    if found.filter("texts > 1").isEmpty():
        return found.select("key", "first")
    forget(found)
    return None


def masked(docs: DataFrame, rules: dict[str, Callable[[Column, Column], Column]], id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, mask) of each row: bit i of mask is set if it fails the i-th rule, the last bit if a smaller id has the same text."""
    rows = docs.select(
        F.col(quoted(id_col)).cast("long").alias("id"), F.coalesce(F.col(quoted(part_col)).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("t"),
    )
    for seed in itertools.count():  # again with other hashes if texts of one key differ, which no one will see
        levels = _levels(F.col("t"), seed)
        words = rows.withColumn("words", F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), ""))
        mask = sum((F.when(fails(F.col("t"), F.col("words")), 1 << i).otherwise(0) for i, fails in enumerate(rules.values())), F.lit(0))
        facts = stored(words.select("id", "part", mask.alias("mask"), *(g.alias(f"g{i}") for i, g in enumerate(levels))), "facts")
        found = first_copies(rows.select("id", "t"), facts, seed)
        if found is not None:
            break
        forget(facts)
    copy = F.when(F.col("id") > F.col("first"), 1 << len(rules)).otherwise(0)
    return facts.join(found, F.col(f"g{len(levels) - 1}") == F.col("key"), "left").select("id", "part", (F.col("mask") + copy).alias("mask"))


def orders(letters: str) -> list[dict]:
    """Each order's steps: the order, the step from 1, its filter's bit and the bits of the filters before it."""
    out = []
    for order in itertools.permutations(range(len(letters))):
        for step, i in enumerate(order, 1):
            out.append({"filter_order": "".join(letters[k] for k in order), "step": step, "bit": 1 << i, "before": sum(1 << k for k in order[: step - 1])})
    return out


def audit(docs: DataFrame, labels: DataFrame, *, rules: dict[str, Callable[[Column, Column], Column]] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """One row for each part, order of the filters (rules' letters and E, duplicates) and step.

    part, filter_order, step; kept, removed, redundant (fails this filter, but went before), unique_fails (fails this filter only), good_lost and toxic_lost (removed here,
    with such a label), shapley (the filter's removed, summed over all orders). A null text is an empty one, a null part the empty string; a row without an id is
    no copy and has no label, but others are not copies of it either. Rows of one id count each; they are no copies of each other. Of
    several labels of an id any that is 1 counts. Any number of rows of one text, part or length: they meet as counts alone. No rows: none.
    """
    rules = RULES if rules is None else rules
    letters = "".join(rules) + DUPLICATES
    rows = masked(docs, rules, id_col, text_col, part_col)
    is_one = lambda c: F.max(F.coalesce((F.col(quoted(c)) == 1).cast("long"), F.lit(0)))
    known = labels.filter(F.col(quoted(id_col)).isNotNull()).groupBy(F.col(quoted(id_col)).cast("long").alias("of")).agg(is_one(quality_col).alias("good"), is_one(toxic_col).alias("toxic"))
    told = rows.join(stored(known, "labels"), F.col("id") == F.col("of"), "left")
    cells = told.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    # at most 2 ** len(letters) cells a part
    parts = stored(cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")), "cells")
    steps = F.from_json(F.lit(json.dumps(orders(letters))), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    each = parts.select("part", "cells", F.explode(steps).alias("s")).select("part", "cells", "s.*")
    bit, before = F.col("bit"), F.col("before")
    has = lambda c, bits: c["mask"].bitwiseAND(bits) != 0
    total = lambda where, value: F.aggregate(F.filter("cells", where), F.lit(0).cast("long"), lambda a, c: a + value(c))
    here = lambda c: has(c, bit) & ~has(c, before)
    n_orders = math.factorial(len(letters))  # of these, a filter of k that a document fails comes first in one in k
    return each.select(
        "part", "filter_order", "step",
        total(lambda c: ~has(c, before.bitwiseOR(bit)), lambda c: c["n"]).alias("kept"),
        total(here, lambda c: c["n"]).alias("removed"),
        total(lambda c: has(c, bit) & has(c, before), lambda c: c["n"]).alias("redundant"),
        total(lambda c: c["mask"] == bit, lambda c: c["n"]).alias("unique_fails"),
        total(here, lambda c: c["good"]).alias("good_lost"),
        total(here, lambda c: c["toxic"]).alias("toxic_lost"),
        total(lambda c: has(c, bit), lambda c: (c["n"] * n_orders / F.bit_count(c["mask"])).cast("long")).alias("shapley"),
    )
