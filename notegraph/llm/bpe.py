"""Byte-level BPE in Spark's higher-order functions.

A text's pieces come from one regular expression. A piece's bytes are an array of ids, over which
aggregate() folds the ranked merges: each step merges the leftmost pair of least rank. Ranks of pairs lie in a
literal map. Distinct frequent words of a bounded sample are folded once and looked up from a second
literal; every other word is folded where it stands, so the ids do not depend on the sample.
"""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.llm.common import quoted, stored

#: Splits a text before the merges; fixed by the vocabulary. White space is spelled out, since Java's \s is ASCII.
SPACE = r"\t-\r \x{85}\p{Z}"
PATTERN = rf"'(?:[stmd]|re|ve|ll)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Documents whose words are counted for the cache, the most words it holds (some 100 bytes each in a task), and words of one of its maps.
SAMPLE_DOCS, CACHED_WORDS, LOAD = 40_000, 524_288, 2


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def literal(values: list, kind: str) -> Column:
    """An array literal; the optimizer folds the parsing away."""
    return F.from_json(F.lit(json.dumps({"a": values})), f"a array<{kind}>")["a"]


class Merges:
    """The rank map of merges as literal arrays, packed by row displacement: a left id's row of right ids lies in the table
    from its move on, in places that other rows leave free, and a check tells whose an entry is. An id is its rank.

    A piece that is a token needs no test of its own, since a token's bytes merge back to it.
    """

    def __init__(self, ranks: dict[bytes, int]):
        rows: dict[int, list[tuple[int, int]]] = {}
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    rows.setdefault(a, []).append((b, i))
        size = max(ranks.values()) + 1
        room = 8 * (size + sum(map(len, rows.values()))) + 16_384
        taken = np.zeros(room, bool)
        self.move, check, made, least = [0] * size, np.full(room, -1), np.zeros(room, np.int64), 0
        for a, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
            right = np.array([b for b, _ in row])
            while taken[least]:
                least += 1
            at = -1
            first = max(0, least - int(right.min())) if len(row) < 4 else a * 7919 % (2 * size)  # long rows are spread
            while at < 0:
                tried = np.arange(first, first + 8192)
                for b in right:  # moves that find every place free; few outlast the first places
                    tried = tried[~taken[tried + b]]
                    if not len(tried):
                        break
                at, first = int(tried[0]) if len(tried) else -1, first + 8192
            self.move[a] = at
            taken[at + right] = True
            check[at + right] = a
            made[at + right] = [i for _, i in row]
        end = int(np.flatnonzero(taken).max()) + 1 if taken.any() else 1
        self.check, self.made = check[:end].tolist(), made[:end].tolist()
        self.bytes = [ranks[bytes([b])] for b in range(256)]

    def rank(self, a: int, b: int) -> int | None:
        at = self.move[a] + b
        return self.made[at] if at < len(self.check) and self.check[at] == a else None

    def bound(self, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
        """body, given the function that folds a piece; the literals stand in the plan once."""
        tables = F.struct(*(literal(getattr(self, k), "int").alias(k) for k in ("move", "check", "made", "bytes")))
        return bind(tables, lambda t: body(lambda piece: fold(piece, t, len(self.move))))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """As let, but body's result is not copied: transform() copies what its lambda returns, number by number in an array, where aggregate() hands on what its finish returns."""
    return F.aggregate(F.array(), value, lambda bound, _: bound, body)


def fold(piece: Column, tables: Column, size: int) -> Column:
    """The ids of one piece: at each step the leftmost of the pairs of least rank is merged. size: of the vocabulary.

    The state is one array with a number for each id: the rank of its pair with the next id, its index, and the id. So the least number
    is the pair to merge and says where it is: array_position() would throw an exception to leave its loop, which takes longer than all
    the rest of a step. The bytes' ids stand between two marks that pair with nothing, so each pair has a left and a right neighbour.
    A pair without a rank counts as more than every rank.
    """
    width = size.bit_length()
    mark, unranked = (1 << width) - 1, 1 << width
    shift = 62 - width  # an index has what the rank and the id leave: 30 bits of a vocabulary of 50,256
    one, below = 1 << width, (1 << shift) - 1

    def rank(a: Column, b: Column) -> Column:
        """The marks have no move and are no entry's left; ids beyond the end are null."""
        return bind(F.get(tables["move"], a) + b, lambda at: F.when(F.get(tables["check"], at) == a, F.get(tables["made"], at)).otherwise(unranked))

    def id_of(x: Column) -> Column:
        return x.bitwiseAND(F.lit(mark).cast("long")).cast("int")

    def ranked(r: Column, rest: Column) -> Column:
        return F.shiftleft(r.cast("long"), shift) + rest

    def merged(s: Column, least: Column, k: Column, new: Column) -> Column:
        """s without its number k + 1. One pass over places, since slice() is slow here."""
        left = F.get(s, k - 1)
        before = ranked(rank(id_of(left), new), left.bitwiseAND(F.lit(below)))
        here = ranked(rank(new, id_of(F.get(s, k + 2))), least.bitwiseAND(F.lit(below - mark)) + new)

        def placed(i: Column, p: Column, q: Column) -> Column:
            return F.when(i < k - 1, F.get(s, i)).when(i > k, F.get(s, i + 1) - F.lit(one).cast("long")).when(i == k, q).otherwise(p)

        return bind(before, lambda p: bind(here, lambda q: F.transform(F.sequence(F.lit(0), F.size(s) - 2), lambda i: placed(i, p, q))))

    def step(s: Column, _: Column) -> Column:
        def merge(least: Column) -> Column:
            """Its index is from 0."""
            index = F.shiftright(least.bitwiseAND(F.lit(below)), width).cast("int")
            return bind(index, lambda k: bind(F.shiftright(least, shift).cast("int"), lambda new: merged(s, least, k, new)))

        return bind(F.array_min(s), lambda least: F.when(least >= F.lit(unranked << shift), s).otherwise(merge(least)))

    def start(ids: Column) -> Column:
        state = F.transform(ids, lambda a, i: ranked(rank(a, F.get(ids, i + 1)), F.shiftleft(i.cast("long"), width) + a))
        return F.aggregate(F.sequence(F.lit(2), F.size(ids) - 2), state, step, lambda s: F.transform(F.slice(s, 2, F.size(s) - 2), id_of))

    letters = F.split(F.decode(F.encode(piece, "utf-8"), "ISO-8859-1"), "")
    marks = F.array(F.lit(mark))
    return bind(F.flatten(F.array(marks, F.transform(letters, lambda c: F.get(tables["bytes"], F.ascii(c))), marks)), start)


def split_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))


def frequent_words(docs: DataFrame, text_col: str, merges: Merges, sample_docs: int, most: int) -> DataFrame:
    """(w, ids) of the words that occur most in a sample of about sample_docs texts; folded as all words are."""
    count = docs.count()
    sample = docs.select(F.col(quoted(text_col)).cast("string").alias("t")).sample(min(1.0, sample_docs / max(1, count)), seed=1)
    words = sample.select(F.explode(split_words(F.col("t"))).alias("w")).groupBy("w").count().filter("count > 1")
    words = words.orderBy(F.desc("count"), "w").limit(most).select("w")
    return stored(words.repartition(8).select("w", merges.bound(lambda folded: folded(F.col("w"))).alias("ids")), "words")


def constant(df: DataFrame) -> Column:
    """The one value of df, an array, as a literal in Spark's binary row format: a few bytes more than the data, where a literal of
    Python values takes an object for each number. A scalar subquery would be the public way, but higher-order functions take none.
    """
    jvm = df.sparkSession._jvm
    row = df._jdf.queryExecution().executedPlan().executeCollect()[0]
    value = jvm.org.apache.spark.sql.catalyst.expressions.Literal(row.getArray(0), df._jdf.schema().apply(0).dataType())
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(value))


def lookup(words: DataFrame) -> Callable[[Callable[[Callable[[Column], Column]], Column]], Column]:
    """Binds the map of (w, ids) to a function of a word that gives its ids, or null: a literal array of small maps, addressed by hash.
    The maps stand in the array by their number; if one did not, its words would be folded like others.
    """
    n = max(1, -(-words.count() // LOAD))
    place = lambda w: F.pmod(F.xxhash64(w), F.lit(n))
    maps = words.groupBy(place(F.col("w")).alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("w", "ids"))).alias("held"))
    every = words.sparkSession.range(n).join(maps, "id", "left").repartition(1).sortWithinPartitions("id")
    held = constant(every.agg(F.collect_list(F.coalesce("held", F.expr("cast(map() as map<string,array<int>>)"))).alias("held")))
    return lambda body: bind(held, lambda m: body(lambda w: F.try_element_at(F.get(m, place(w).cast("int")), w)))


def encode(docs: DataFrame, vocabulary_path: str, *, text_col: str = "text", ids_col: str = "token_ids", sample_docs: int = SAMPLE_DOCS, cached_words: int = CACHED_WORDS) -> DataFrame:
    """docs with the token ids of each whole text in ids_col, as array<int>.

    Null and empty texts: an empty array. Repeated rows, nulls in other columns and further columns
    pass as they are; a column named ids_col is replaced. Time is linear in a text's length, but
    quadratic in that of one unbroken piece, as in the plain merge loop.
    """
    merges = Merges(read_ranks(vocabulary_path))
    cached = lookup(frequent_words(docs, text_col, merges, sample_docs, cached_words))
    ids = merges.bound(lambda folded: cached(lambda known: F.flatten(F.transform(split_words(F.col(quoted(text_col)).cast("string")), lambda w: F.coalesce(known(w), folded(w))))))
    return docs.withColumn(ids_col, ids)


def piece_table(vocabulary_path: str) -> list[str]:
    """Each id's bytes, in hex."""
    ranks = read_ranks(vocabulary_path)
    table = [""] * (max(ranks.values()) + 1)
    for k, v in ranks.items():
        table[v] = k.hex()
    return table


def decode(ids: Column, vocabulary_path: str) -> Column:
    """The bytes of a sequence of ids: their binary pieces, one after another. Ids outside the vocabulary give null."""
    pieces = literal(piece_table(vocabulary_path), "string")
    return bind(pieces, lambda p: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(p, i)), "", null_replacement="!")))


def packed(ids: Column, size: int) -> Column:
    """ids as little-endian unsigned 32-bit integers. size: of the vocabulary."""
    words = literal([struct.pack("<I", i).hex() for i in range(size)], "string")
    return bind(words, lambda p: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(p, i)), "")))
