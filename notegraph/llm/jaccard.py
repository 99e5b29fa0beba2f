"""Exact n-gram Jaccard join by PartEnum signatures.

Sets are banded by size so that only equal or adjacent bands can be similar enough. For a pair of bands the
threshold bounds the symmetric difference by some k. The domain of shingles is cut into first-level parts, of which all but
k // (k2 + 1) differ in no more than k2 elements, and each part into second-level ones; every choice of all but k2 of these is one signature, so similar sets share
signatures in so many parts. A signature of no elements says nothing and is left out. So many parts are cut that
few sets have as many parts with such a signature as must match; those that do are signed anew with another cut.

Sharing a signature only makes candidates. Chance pairs chain ever more documents to one component as the input grows, so large components
are cut by sketches: counts of shingles by cells, which bound what two sets have in common. What is left of them is small or is cut in blocks,
and inside components every link is verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.llm.common import forget, met_with, quoted, release, sized, small_batches, stored
from notegraph.llm.graph import components

U = np.uint64
P1, P2, P3 = U(0x9E3779B185EBCA87), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
WORDS = 500_000
#: Documents of one candidate component that a task verifies together; larger components go by pairs of blocks.
BLOCK = 2048
#: Cells of a sketch, which counts up to 255 shingles in each, and sketches of a block: those of equal or adjacent bands of sizes meet in pairs of blocks.
CELLS, SKETCHES = 512, 8192
#: Documents whose signatures leave a task together; documents for which a bucket of signatures is made, and the least buckets.
FORWARD_DOCS, BUCKET_DOCS, BUCKETS = 2048, 8192, 128
#: Cuts of the domain that are tried for a set with too many empty signatures.
CUTS = 6


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * P2
    x = (x ^ (x >> U(29))) * P3
    return x ^ (x >> U(32))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles; words are cut at ASCII white space, A-Z in lower case."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        known, digest = self.known, xxhash.xxh3_64_intdigest
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, U)
        if len(known) > WORDS:
            known.clear()
        hashes = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = digest(w)
            hashes.append(h)
        h = np.array(hashes, U)
        n = min(self.width, len(h))
        out = np.full(len(h) - n + 1, U(n) * P3)
        for i in range(n):
            out = mix(out ^ h[i : len(h) - n + 1 + i]) + P1
        return np.unique(out)


@cache
def cut(k: int, n: int) -> tuple[int, int, int, int]:
    """(parts, n2, k2, t) for sets of n elements or more that differ in at most k: t parts at least match. The fewest signatures with which few sets have t parts with an empty one."""
    found = []
    for k2, n2 in ((1, 3), (2, 5), (3, 7)):
        for t in range(1, 5 + k // 16):
            parts = k // (k2 + 1) + t
            size = parts * math.comb(n2, k2)
            empty = size * math.exp(-n * (n2 - k2) / (parts * n2))  # signatures that are empty, on average
            tail = 1 - sum(math.exp(i * math.log(empty) - empty - math.lgamma(i + 1)) for i in range(t))
            if k2 <= k and size <= 60 + 1.2 * n:
                found.append(((tail >= 0.1) * tail, size, parts, n2, k2, t))
    return min(found)[2:]


class Signatures:
    """PartEnum signatures for num / den as least Jaccard similarity."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low = [1]

    def band(self, size: int) -> int:
        while self.low[-1] <= size:
            self.low.append(self.low[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.low, size, "right")) - 1

    def __call__(self, s: np.ndarray) -> np.ndarray:
        if not len(s):
            return np.empty(0, U)
        b = self.band(len(s))
        return np.concatenate([self.group(s, g) for g in ((b - 1, b) if b else (b,))])

    def group(self, s: np.ndarray, g: int) -> np.ndarray:
        """The signatures for pairs of which one set is of band g and the other of g or g + 1."""
        while len(self.low) < g + 3:
            self.low.append(self.low[-1] * self.den // self.num + 1)
        k = (self.den - self.num) * (self.low[g + 1] + self.low[g + 2] - 2) // (self.den + self.num)
        if k == 0:
            return np.empty(0, U)  # only equal sets are similar enough, and those are one class
        parts, n2, k2, t = cut(k, self.low[g])
        chosen = np.array(list(combinations(range(n2), n2 - k2))).T
        out = []
        for salt in range(CUTS):
            seed = mix(np.array([(g + 1) * CUTS + salt], U) * P1)[0]
            place = (mix(s ^ seed) % U(n2 * parts)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            place = place[order]
            first = np.flatnonzero(np.diff(place, prepend=-1))
            sums, filled = np.zeros(n2 * parts, U), np.zeros(n2 * parts, bool)
            sums[place[first]] = np.add.reduceat(mix(s[order] + P3), first)
            filled[place[first]] = True
            sums, filled = sums.reshape(parts, n2), filled.reshape(parts, n2)
            sig = mix(np.arange(parts * chosen.shape[1], dtype=U) * P1 + seed).reshape(parts, -1)
            some = np.zeros(sig.shape, bool)
            for column in chosen:
                sig = mix(sig * P1 + sums[:, column])
                some |= filled[:, column]
            out.append(sig[some])
            if np.count_nonzero(~some.all(axis=1)) < t:
                break  # of t parts that match, one has elements
        else:
            out.append(mix(np.array([g + 1], U) * P2))  # what no cut helps is a candidate of all alike
        return np.concatenate(out)


def _class_key(s: np.ndarray) -> tuple[int, int]:
    """A set's identity: 128 bits."""
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return (d >> 64) - 2**63, (d & (2**64 - 1)) - 2**63


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def digests(rows: DataFrame, width: int) -> DataFrame:
    """(doc_id, copy, n_shingles, h1, h2) of rows (doc_id, text): equal sets have equal h1 and h2; copy is the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in batches:
            found = [(len(s), *_class_key(s)) for s in map(shingle, batch.column(2).to_pylist())]
            cols = list(zip(*found, strict=True)) if found else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "copy", "n_shingles", "h1", "h2"])

    return rows.select("doc_id", F.xxhash64("text").alias("copy"), "text").mapInArrow(run, "doc_id long, copy long, n_shingles long, h1 long, h2 long")


def _signature_rows(rows: DataFrame, width: int, num: int, den: int, buckets: int) -> DataFrame:
    """(bucket, held) for each block of documents: the signatures of a bucket and their classes, as packed() has them.

    A block forwards one class for each signature and links its others to that one by a signature of the two, so a
    signature that a third of all rows share is a few entries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, enum = Shingler(width), Signatures(num, den)
        sigs, keys, seen = [], [], set()

        def out() -> pa.RecordBatch:
            s = np.concatenate(sigs) if sigs else np.empty(0, U)
            of = np.repeat(np.arange(len(keys)), [len(x) for x in sigs])
            order = np.lexsort((of, s))
            s, of = s[order], of[order]
            new = np.diff(s, prepend=s[:1]) != 0
            new[:1] = True
            lead = of[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]
            lead, far = np.unique(np.stack([lead[~new], of[~new]]), axis=1)
            h = np.array(keys, np.int64)
            own = mix(h[lead].view(U) * P1 + mix(h[far].view(U) ^ P2))
            s, of = np.concatenate([s[new], own, own]), np.concatenate([of[new], lead, far])
            to = (s % U(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            at = np.flatnonzero(np.diff(to[order], prepend=-1))
            held = [packed(s[x], of[x], h) for x in np.split(order, at[1:])] if len(at) else []
            return pa.RecordBatch.from_arrays([pa.array(to[order][at]), pa.array(held, pa.binary())], ["bucket", "held"])

        for batch in batches:
            for s in map(shingle, batch.column(1).to_pylist()):
                if len(s) and (key := _class_key(s)[0]) not in seen:
                    seen.add(key)
                    keys.append(key)
                    sigs.append(enum(s))
            if len(keys) >= FORWARD_DOCS:
                yield out()
                sigs.clear()
                keys.clear()
                if len(seen) > WORDS:
                    seen.clear()
        yield out()

    return rows.mapInArrow(run, "bucket long, held binary")


def packed(s: np.ndarray, of: np.ndarray, h: np.ndarray) -> bytes:
    """Signatures s of the classes h[of]: how many classes there are here, the classes, the signatures, and each one's class by number."""
    here, of = np.unique(of, return_inverse=True)
    return b"".join((np.array([len(here), len(s)], np.int64).tobytes(), h[here].tobytes(), s.tobytes(), of.astype(np.uint16 if len(here) < 1 << 16 else np.int64).tobytes()))


def unpacked(held: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of packed(), and the class of each."""
    m, n = np.frombuffer(held, np.int64, 2)
    kind = np.uint16 if m < 1 << 16 else np.int64
    h = np.frombuffer(held, np.int64, m, 16)
    return np.frombuffer(held, U, n, 16 + 8 * m), h[np.frombuffer(held, kind, n, 16 + 8 * (m + n))]


def _edges(rows: DataFrame) -> DataFrame:
    """Candidate edges (a, b) of rows (bucket, held): each class of a signature to the signature's least. A task holds a bucket at a time."""

    def star(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        s, h = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, U), np.empty(0, np.int64))
        order = np.argsort(s)
        s = s[order]
        same = s[1:] == s[:-1]
        shared = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(s) else np.empty(0, bool)
        s, h = s[shared], h[order][shared]
        first = np.flatnonzero(np.diff(s, prepend=~s[:1]))
        least = np.repeat(np.minimum.reduceat(h, first), np.diff(np.append(first, len(h)))) if len(h) else h
        a, b = np.unique(np.stack([least, h])[:, least != h], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for bucket, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now:
                    yield star(parts)
                    now, parts = bucket, []
                parts.append(unpacked(held.as_buffer().to_pybytes()))
        yield star(parts)

    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _linked(a: np.ndarray, n: int, sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    return (a > 0) & (a * (num + den) >= num * (n + sizes))


class _Postings:
    """Counts of common shingles of one set with each of many."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        every = np.concatenate(sets)
        of = np.repeat(np.arange(self.n), [len(s) for s in sets])
        order = np.argsort(every, kind="stable")
        self.values, start = np.unique(every[order], return_index=True)
        self.of, self.start = of[order], np.append(start, len(every))

    def common(self, s: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.values, s), len(self.values) - 1)
        at = at[self.values[at] == s]
        lo, hi = self.start[at], self.start[at + 1]
        if not len(lo):
            return np.zeros(self.n, np.int64)
        n = hi - lo
        spread = np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        return np.bincount(self.of[spread], minlength=self.n)


def verify(nodes: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact links among sets (with side: only between its two values): each node's least reachable node, and the copies of the nodes it links with."""
    m = len(nodes)
    sizes = np.array([len(s) for s in sets])
    parent = list(range(m))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    degree = np.zeros(m, np.int64)
    held = _Postings(sets)
    for i in range(m):
        linked = _linked(held.common(sets[i]), sizes[i], sizes, num, den)
        linked[i] = False
        if side is not None:
            linked &= side != side[i]
        at = np.flatnonzero(linked)
        degree[i] = copies[at].sum()
        for j in at[at > i] if side is None else at:
            a, b = root(i), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
    roots = np.array([root(i) for i in range(m)])
    least = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(least, roots, nodes)
    return least[roots], degree


def sketch(s: np.ndarray) -> bytes | None:
    """How many of a set's shingles are in each cell; nothing where that is more than a byte holds."""
    n = np.bincount((mix(s ^ P3) % U(CELLS)).astype(np.int64), minlength=CELLS)
    return n.astype(np.uint8).tobytes() if n.max() < 256 else None


def _sketches(texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(c, node, band, cells) of rows (c, node, text): the band of the set's size and its sketch()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, bands = Shingler(width), Signatures(num, den)
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            found = [(c, node, bands.band(len(s)), sketch(s)) for c, node, s in ((c, node, shingle(text)) for c, node, text in rows) if len(s) and _class_key(s)[0] == node]  # not another text of the row's id
            cols = list(zip(*found, strict=True)) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if i == 3 else pa.int64()) for i, x in enumerate(cols)], ["c", "node", "band", "cells"])

    return texts.select("c", "node", "text").mapInArrow(run, "c long, node long, band long, cells binary").dropDuplicates(["node"])


def likely(cells: np.ndarray, known: np.ndarray, side: np.ndarray | None, num: int, den: int) -> np.ndarray:
    """Each sketch's group: the least place that it reaches by pairs (with side: of its two values) that may be similar enough. Two sets have no more in common than the lesser count of each cell, summed; one that is not known may be like all."""
    size = np.where(known, cells.sum(axis=1, dtype=np.int64), 0)
    coarse = cells.reshape(len(cells), 64, CELLS // 64).sum(axis=2, dtype=np.uint16)  # rules most pairs out
    group, order = np.arange(len(cells)), np.argsort(size, kind="stable")
    sides = [(order, order)] if side is None else [(order[side[order] == v], order[side[order] != v]) for v in np.unique(side)]
    for own, other in sides:
        sizes, held = size[other], coarse[other]
        for i in own:
            # the other is at least as large, and no larger than num / den allows
            lo, hi = (np.searchsorted(sizes, size[i]), np.searchsorted(sizes, size[i] * den // num, "right")) if known[i] else (0, len(other))
            at = other[lo:hi]
            for one, many in ((coarse[i], held[lo:hi]), (cells[i], None)) if known[i] else ():
                most = np.minimum(cells[at] if many is None else many, one).sum(axis=1, dtype=np.int64)
                at = at[most * (num + den) >= num * (size[i] + size[at])]
            met = np.unique(np.append(group[at], group[i]))
            if len(met) > 1:
                group[np.isin(group, met[1:])] = met[0]
    return group


def _cut(sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) among the sketches (c, node, band, cells) of each component c, that join all that may be similar enough. Equal and adjacent bands meet, by pairs of blocks, and a task holds one pair at a time. Those without a sketch meet the whole band."""
    sizes = sketches.groupBy("c", "band").agg(F.ceil(F.count("*") / SKETCHES).cast("int").alias("n"))
    block = F.struct("band", F.pmod(F.xxhash64("node"), F.col("n")).cast("long").alias("block"))
    cut = sketches.join(sizes, ["c", "band"]).select("c", "node", "band", "n", "cells", block.alias("own"))
    near = sizes.select("c", F.col("band").alias("far"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block")).select("c", "far", F.struct(F.col("far").alias("band"), F.col("block").cast("long").alias("block")).alias("other"))
    bands = cut.select("*", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("far"))
    dealt = bands.join(F.broadcast(near), ["c", "far"]).select("c", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") < F.col("other")).alias("side"), "node", "cells")
    dealt = dealt.select("c", F.col("i.band").alias("p"), F.col("i.block").alias("i"), F.col("j.band").alias("q"), F.col("j.block").alias("j"), "side", "node", "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> pa.RecordBatch:
            nodes = np.array([r[0] for r in held], np.int64)
            known = np.array([r[2] is not None for r in held], bool)
            cells = np.frombuffer(b"".join(r[2] or bytes(CELLS) for r in held), np.uint8).reshape(-1, CELLS)
            same = now is None or now[1:3] == now[3:5]
            group = likely(cells, known, None if same else np.array([r[1] for r in held], bool), num, den)
            held.clear()
            far = group != np.arange(len(group))
            return pa.RecordBatch.from_arrays([pa.array(nodes[group[far]]), pa.array(nodes[far])], ["a", "b"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:5] != now:
                    yield close()
                    now = r[:5]
                held.append((r[6], r[5], r[7]))
        yield close()

    keys = ["c", "p", "i", "q", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "side", "node", "cells").mapInArrow(run, "a long, b long")


def _verified(blocks: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(c, whole, node, least, degree) of rows (c, i, j, side, whole, node, copies, text), by key (c, i, j), of which a task holds one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        now, held, rows = None, {}, []

        def close():
            if held:
                nodes, copies, sides = (np.array([r[i] for r in held.values()], np.int64) for i in (5, 6, 3))
                least, degree = verify(nodes, copies, [r[7] for r in held.values()], None if now[1] == now[2] else sides, num, den)
                whole = next(iter(held.values()))[4]
                rows.extend((now[0], whole, int(a), int(b), int(d)) for a, b, d in zip(nodes, least, degree, strict=True))
                held.clear()

        def out():
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if i == 1 else pa.int64()) for i, c in enumerate(cols)], ["c", "whole", "node", "least", "degree"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:3] != now:
                    close()
                    now = r[:3]
                if r[5] not in held and _class_key(s := shingle(r[7]))[0] == r[5]:  # not another text of the row's id
                    held[r[5]] = (*r[:7], s)
            if len(rows) > 10_000:
                yield out()
        close()
        yield out()

    dealt = blocks.repartition("c", "i", "j").sortWithinPartitions("c", "i", "j")
    return dealt.select("c", "i", "j", "side", "whole", "node", "copies", "text").mapInArrow(run, "c long, whole boolean, node long, least long, degree long")


def join(docs: DataFrame, *, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (least doc_id reachable by links, its own included) and n_links (documents it links with).

    Two documents link when den * common shingles >= num * all shingles of both. Fewer words than width:
    the sequence is one shingle. Null, empty or blank text: no shingles, no links. Vertices are texts: rows of one id with
    different texts are several, and nothing is reachable through a shared id. A row without an id has the component of a row with its set, if any, else null. No rows: none.

    Equal sets are one class from the start. What moves are digests, signatures, sketches of large components and, once, the
    texts of candidate classes; components that still have more than BLOCK classes are verified by pairs of blocks.
    """
    return _joined(docs, width, num, den, id_col, text_col).drop("copy")


def _joined(docs: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """join()'s rows with copy, the hash of the row's text."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    digest = stored(digests(rows, width), "digests")
    buckets = max(BUCKETS, digest.count() // BUCKET_DOCS)
    classes = digest.filter("n_shingles > 0").groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    edges = stored(_edges(_signature_rows(rows, width, num, den, buckets)), "candidates")
    release(docs.sparkSession)  # signatures are most of what moves
    candidates = components(edges)
    nodes = stored(classes.filter("rep is not null").join(candidates, F.col("h1") == F.col("node")).select("node", "rep", "copies", F.col("component").alias("c")), "nodes")
    large = nodes.groupBy("c").agg(F.count("*").alias("m")).filter(F.col("m") > BLOCK).select("c")
    done = [nodes]
    large = stored(nodes.join(large, "c").select("c", "node", F.col("rep").alias("doc_id")), "large")
    if not large.isEmpty():
        sketches = stored(_sketches(met_with(rows, large, ["doc_id"]), width, num, den), "sketches")
        tight = stored(_cut(sketches, num, den), "tight")
        done += [sketches, tight]
        release(docs.sparkSession)
        tight = components(tight).select("node", F.col("component").alias("own"))
        apart = large.select("node", F.lit(True).alias("large")).join(tight, "node", "left")
        nodes = nodes.join(apart, "node", "left").filter("large is null or own is not null").select("node", "rep", "copies", F.coalesce("own", "c").alias("c"))  # a class that is like no other needs no verification
    sizes = nodes.groupBy("c").agg(F.count("*").alias("m"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    chosen = stored(nodes.join(sizes, "c").select("node", "rep", "copies", "c", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block")), "chosen")
    for table in (edges, large, *done):
        forget(table)
    texts = rows.join(sized(chosen), F.col("doc_id") == F.col("rep"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = texts.select("c", "blocks", "block", each, "node", "copies", "text").select(
        "c", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("block").alias("side"), (F.col("blocks") == 1).alias("whole"), "node", "copies", "text"
    )
    found = stored(_verified(dealt, width, num, den), "verified")
    wide = components(found.filter("not whole and node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")))
    roots = found.groupBy("node").agg(F.sum("degree").alias("degree"), F.min(F.when(F.col("whole"), F.col("least"))).alias("least"))
    roots = roots.join(wide.select("node", F.col("component").alias("wide")), "node", "left").select("node", "degree", F.coalesce("least", "wide", "node").alias("root"))
    linked = stored(classes.join(roots, F.col("h1") == F.col("node")).select("n_shingles", "h1", "h2", "rep", "copies", "degree", "root"), "linked")
    forget(chosen)
    forget(found)
    firsts = linked.groupBy("root").agg(F.min("rep").alias("first"))
    linked = linked.join(firsts, "root").select(F.col("n_shingles").alias("n"), F.col("h1").alias("k1"), F.col("h2").alias("k2"), "first", "degree")
    same = lambda: (F.col("n_shingles") == F.col("n")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))
    # A class of one document that is no candidate needs no join.
    many = classes.filter("copies > 1").join(linked, same(), "full").select(
        F.coalesce("n_shingles", "n").alias("n"), F.coalesce("h1", "k1").alias("k1"), F.coalesce("h2", "k2").alias("k2"), F.coalesce("first", "rep").alias("component"), (F.coalesce("degree", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("links")
    )
    return digest.join(many, same(), "left").select("doc_id", "copy", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def drop_near_copies(docs: DataFrame, *, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that are not the first (by id) of their component. Of an id's rows only those whose text is such a copy go; rows without an id stay."""
    found = _joined(docs, width, num, den, id_col, text_col)
    gone = stored(found.filter("component_id < doc_id").select(F.struct("doc_id", "copy").alias("copy")).distinct(), "gone")
    row = F.struct(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.xxhash64(F.col(quoted(text_col)).cast("string")).alias("copy"))
    whole = docs.select(F.struct("*").alias("row"), row.alias("of"))
    return whole.join(sized(gone), F.col("of") == F.col("copy"), "left_anti").select("row.*")
