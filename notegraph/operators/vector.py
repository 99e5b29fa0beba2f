"""Exact vector search: one query's top K in columns, many queries' in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegraph.functions.scalars import cosine_distance

#: Rows of a block of knn() at most; the blocks that a side is cut in, if they have LEAST_BLOCK rows, so that few rows are shared among tasks too.
BLOCK, SIDE, LEAST_BLOCK = 32_768, 6, 1024
#: Rows of two blocks that are multiplied at a time, and pairs that are looked at once more at a time.
SOURCES, TARGETS, CHUNK = 1024, 4096, 65_536
#: More than what single precision can be wrong by in a product of two vectors of length 1.
MARGIN = np.float32(1e-4)


def ranked(hits: DataFrame, *order) -> DataFrame:
    """hits of at most K rows with their rank from 1; the window is over those rows alone."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))


def top_k(notes: DataFrame, embeddings: DataFrame, query: list[float], k: int) -> DataFrame:
    """(note_id, distance, rank) of the k notes nearest to query by cosine; ties, to 12 digits, by id. A note with several vectors appears several times. A vector without a direction is near to nothing, so that its note is not among them."""
    scored = embeddings.withColumn("distance", cosine_distance(F.col("embedding"), F.array(*(F.lit(float(x)) for x in query)))).filter(F.col("distance").isNotNull())
    ids = [c for c in ("note_id", "image_id") if c in embeddings.columns]
    near = scored.select(*ids, "distance").join(notes.select("note_id"), "note_id").orderBy(F.round("distance", 12), *ids).limit(k)
    return ranked(near, F.round("distance", 12), *ids)


def _unit(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors): the rows whose vector has a direction, and these scaled to length 1."""
    whole = column.combine_chunks()
    m = whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1)
    norm = np.linalg.norm(m, axis=1)
    rows = np.flatnonzero(np.isfinite(norm) & (norm > 0))
    return rows, m[rows] / norm[rows, None]


def _first_copies(v: np.ndarray, k: int) -> np.ndarray:
    """The places of the first k + 1 of all equal rows: of a target's copies no source takes more, its own being one."""
    _, same = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(same, kind="stable")
    at = np.arange(len(order))
    starts = np.maximum.accumulate(np.where(np.diff(same[order], prepend=-1) != 0, at, 0))
    return np.sort(order[at - starts <= k])


def nearest(ids: np.ndarray, u: np.ndarray, others: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, distance) of each row's k nearest others; others ascend. Single precision, by tiles, finds what may be among them, and double precision decides."""
    single, out = v.astype(np.float32), []
    for a in range(0, len(u), SOURCES):
        part = u[a : a + SOURCES]
        least = np.full(len(part), -np.inf, np.float32)
        row, col, dist = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for b in range(0, len(v), TARGETS):
            like = part.astype(np.float32) @ single[b : b + TARGETS].T
            if not b and like.shape[1] > k + 1:
                least = np.partition(like, like.shape[1] - k - 1, axis=1)[:, -k - 1] - MARGIN
            r, c = np.nonzero(like >= least[:, None])
            c += b
            other = ids[a + r] != others[c]
            r, c = r[other], c[other]
            d = 1 - np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", part[r[i : i + CHUNK]], v[c[i : i + CHUNK]]) for i in range(0, len(r), CHUNK))])
            row, col, dist = np.concatenate([row, r]), np.concatenate([col, c]), np.concatenate([dist, d])
            order = np.lexsort((col, np.round(dist, 12), row))
            row, col, dist = row[order], col[order], dist[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            last = place == k - 1
            least[row[last]] = np.maximum(least[row[last]], 1 - dist[last] - MARGIN)
            row, col, dist = row[place < k], col[place < k], dist[place < k]
        out.append((row + a, col, dist))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def knn(rows: DataFrame, k: int, *, sources: DataFrame | None = None, block: int = BLOCK, id_col: str = "note_id", vector_col: str = "embedding", within: str | None = None) -> DataFrame:
    """(source_id, target_id, distance) of the k nearest others of each of sources, or of each row, by cosine, ties by id. Ids are of any type that orders; vectors are of one length. within: a column that both must share; each of its groups is cut in blocks of its own.

    Both sides are cut in blocks, of `block` rows at most and in SIDE blocks at least, if these have LEAST_BLOCK rows; a task multiplies two blocks by tiles and keeps the best k of each source, and a window merges blocks' bests. No side is
    broadcast. What moves is rows times blocks of sources and the other way round: for a batch of new sources in proportion to rows, for all rows their square.
    """
    asked, kind = rows if sources is None else sources, rows.schema[id_col].dataType.simpleString()
    own = lambda count: F.pmod(F.xxhash64("id"), F.col(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count).cast("int") - 1))
    group = F.lit(0) if within is None else F.col(within)
    side = lambda df: df.filter(F.col(vector_col).isNotNull()).select(group.alias("g"), F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    size = lambda n: F.least(F.lit(block), F.greatest(F.lit(min(block, LEAST_BLOCK)), F.ceil(n / SIDE)))
    blocks = lambda df, name: side(df).groupBy("g").agg(F.ceil(F.count("*") / size(F.count("*"))).cast("int").alias(name))
    if within is None:
        count = lambda df: max(1, sum(r[0] for r in blocks(df, "n").select("n").collect()))  # noqa: E731  one group
        n = count(rows)
        m = n if sources is None else count(sources)
        cut = lambda df: df.select("*", F.lit(n).alias("n"), F.lit(m).alias("m"))
    else:  # each group is cut by its own size
        sizes = blocks(rows, "n").join(blocks(asked, "m"), "g")
        cut = lambda df: df.join(sizes, "g")
    left = cut(side(asked)).select("g", own("m").alias("a"), each("n").alias("b"), "id", "v")
    right = cut(side(rows)).select(F.col("g").alias("h"), each("m").alias("x"), own("n").alias("y"), F.col("id").alias("other"), F.col("v").alias("w"))

    def pair(x: pa.Table, y: pa.Table) -> pa.Table:
        names, of = ["source_id", "target_id", "distance"], x.schema.field("id").type
        if not len(x) or not len(y):
            return pa.table({"source_id": pa.array([], of), "target_id": pa.array([], of), "distance": pa.array([], pa.float64())})
        (i, u), (j, v) = _unit(x["v"]), _unit(y["w"])
        ids, others = x["id"].to_numpy()[i], y["other"].to_numpy()[j]
        order = np.argsort(others, kind="stable")
        order = order[_first_copies(v[order], k)] if len(order) else order
        others = others[order]
        row, col, dist = nearest(ids, u, others, v[order], k)
        return pa.table(dict(zip(names, (pa.array(ids[row], of), pa.array(others[col], of), dist), strict=True)))

    partial = left.groupBy("g", "a", "b").cogroup(right.groupBy("h", "x", "y")).applyInArrow(pair, f"source_id {kind}, target_id {kind}, distance double")
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(F.round("distance", 12), "target_id"))
    return partial.withColumn("place", place).filter(F.col("place") <= k).drop("place")
