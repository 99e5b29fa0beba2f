"""Exact top-k by inner product with no-random-access aggregation.

Candidates are cut into groups of bounded rows, and those into blocks. In a block each dimension is a list sorted by its contribution to
the query's score. The lists are read in step, from the best contribution on; what has been
read gives each row a lower and an upper bound, and reading stops once no more than a few rows can
still reach the k-th best lower bound. The scores of those few are then resolved.

A query's first group yields a score that k rows reach; it is the bound with which the query goes on to
all other groups, so the more groups there are, the smaller the share of the entries that is read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegraph.llm.common import quoted, stored

GROUP_ROWS, BLOCK_ROWS, QUERY_ROWS = 16_384, 4096, 4096
#: Steps in which a block's lists are read, and the rows of a block that are few enough to be resolved.
STEPS, RESOLVE = 16, 1024


def quantise(rows: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, as double. Rows with a null id, a null or empty vector, or a null or non-finite component are left out."""
    x = F.col(quoted(vector_col))
    fit = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(scale)).cast("double"))
    return rows.filter(fit & F.col(quoted(id_col)).isNotNull()).select(F.col(quoted(id_col)).cast("long").alias("vec_id"), v.alias("v"))


class Lists:
    """The sorted lists of one block of candidates, cut into steps."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.n, self.dims = x.shape
        up = np.argsort(x, axis=0, kind="stable").T  # a list for each dimension, by rising value, and then one by falling value
        order = np.concatenate([up, up[:, ::-1]])
        values = np.take_along_axis(np.concatenate([x.T, x.T]), order, axis=1)
        self.ends = [*range(max(64, -(-self.n // STEPS)), self.n, max(64, -(-self.n // STEPS))), self.n]
        self.steps = [(np.ascontiguousarray(order[:, a:b]), np.ascontiguousarray(values[:, a:b])) for a, b in zip([0, *self.ends], self.ends, strict=False)]
        self.depth = len(self.ends) // 2  # the step before which searches without a bound did not end
        # Of entries that were read, and heads for the others, mean and variance over the rows, after each step.
        done, rest, heads = values.cumsum(axis=1), (values**2).cumsum(axis=1), values[:, np.array(self.ends) - 1]
        ends = np.array(self.ends)
        self.mean = (done[:, ends - 1] + heads * (self.n - ends)) / self.n
        self.var = np.maximum((rest[:, ends - 1] + heads**2 * (self.n - ends)) / self.n - self.mean**2, 0)

    def _sums(self, lists: np.ndarray, q: np.ndarray, steps: int, unseen: np.ndarray) -> np.ndarray:
        """Each row's bound after so many steps: what its entries that were read add, and for each other list what it is counted with."""
        total = np.full(self.n, unseen.sum())
        for order, values in self.steps[:steps]:
            gain = values.take(lists, axis=0)
            gain *= q[:, None]
            gain -= unseen[:, None]
            total += np.bincount(order.take(lists, axis=0).ravel(), weights=gain.ravel(), minlength=self.n)
        return total

    def search(self, query: np.ndarray, own, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best rows but own, ties by smaller id, and the number of list entries read. floor: a score below which rows aren't wanted."""
        used = np.flatnonzero(query)  # a list without weight adds nothing
        q, lists = query[used], used + self.dims * (query[used] > 0)
        others, known, read = self.ids != own, floor > -np.inf, 0
        alive = np.flatnonzero(others)
        # The step to begin with: where a normal law leaves few rows over the bound. Only speed depends on it.
        over = floor - q @ self.mean[lists] - np.sqrt(q**2 @ self.var[lists]) if known else None
        at = self.depth if over is None else int(np.argmax(over >= 0)) if (over >= 0).any() else len(self.ends) - 1
        while len(used):
            upper = self._sums(lists, q, at + 1, q * self.steps[at][1][lists, -1])
            bound, read = floor, len(used) * self.ends[at]
            if not known and self.n > k:
                lower = np.where(others, self._sums(lists, q, at + 1, q * self.steps[-1][1][lists, -1]), -np.inf)
                bound = np.partition(lower, self.n - k)[self.n - k]
            alive = np.flatnonzero((upper >= bound - 0.5) & others)  # scores are whole numbers
            if len(alive) <= max(RESOLVE, k) or at + 1 == len(self.ends):
                self.depth = self.depth if known else max(0, at - (len(alive) < RESOLVE // 4))
                break
            at += 1
        score = self.x[alive] @ query
        best = np.lexsort((self.ids[alive], -score))[:k]
        return self.ids[alive][best], score[best], read


def _best(ids: np.ndarray, x: np.ndarray, queries: list[tuple[int, np.ndarray, float]], k: int) -> pd.DataFrame:
    """The k best of a group of candidates for each query (id, vector, floor), block by block: what one block has found bounds the next. Its floor is then the k-th best score, if there are so many."""
    found = [(np.empty(0, np.int64), np.empty(0), floor, 0) for *_, floor in queries]
    cuts = [0, *range(BLOCK_ROWS // 4, len(ids), BLOCK_ROWS), len(ids)]  # the first block, which nothing bounds, is a small one
    for a, b in zip(cuts, cuts[1:], strict=False):
        lists = Lists(ids[a:b], x[a:b])
        for i, (own, v, _) in enumerate(queries):
            had, scores, floor, read = found[i]
            new, reached, entries = lists.search(v, own, k, floor)
            had, scores = np.concatenate([had, new]), np.concatenate([scores, reached])
            best = np.lexsort((had, -scores))[:k]
            had, scores = had[best], scores[best]
            found[i] = had, scores, max(floor, scores[-1]) if len(best) == k else floor, read + entries
    rows = [(own, c, int(s), floor if np.isfinite(floor) else None, read) for (own, *_), (had, scores, floor, read) in zip(queries, found, strict=True) for c, s in zip(had, scores, strict=True)]
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score", "floor", "entries_read"])


def found_by_group(rows: DataFrame, queries: DataFrame, *, k: int, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(query_id, vec_id, score, floor, entries_read): each query's k best of each group of candidates that reach its bound."""
    c, q = (quantise(x, id_col, vector_col, scale) for x in (rows, queries))
    n_c, n_q = max(1, -(-c.count() // GROUP_ROWS)), max(1, -(-q.count() // QUERY_ROWS))
    spread = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    c = c.select("vec_id", "v", F.size("v").alias("dims"), spread(n_c, 1).alias("c"))
    q = q.select("vec_id", "v", F.size("v").alias("dims"), spread(n_q, 2).alias("q"), spread(n_c, 3).alias("home"))

    def group(mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(asked):
            return pd.DataFrame([], columns=["query_id", "vec_id", "score", "floor", "entries_read"])
        wanted = [(own, np.asarray(v), -np.inf if pd.isna(floor) else floor) for own, v, floor in zip(asked.vec_id.to_numpy(), asked.v.to_numpy(), asked.floor.to_numpy(float), strict=True)]
        return _best(mine.vec_id.to_numpy(), np.stack(mine.v.to_numpy()), wanted, k)

    def meet(mine: DataFrame, asked: DataFrame, *keys: str) -> DataFrame:
        return mine.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(group, "query_id long, vec_id long, score long, floor double, entries_read long")

    first = meet(c, q.withColumn("c", F.col("home")).withColumn("floor", F.lit(None).cast("double")), "c", "dims")
    if n_c == 1:
        return first
    first = stored(first, "first_group")
    floors = first.groupBy("query_id").agg(F.min("floor").alias("floor"))
    each = F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_c - 1)), lambda i: i != F.col("home")))
    asked = q.join(floors, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", "dims", "q", "floor", others.alias("c"))
    return first.unionByName(meet(c.withColumn("q", each), asked, "c", "q", "dims"))


def search(rows: DataFrame, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """Each query's k best candidates of another id: query_id, rank from 1, vec_id, score; all, if fewer; ties to the smaller id.

    Score: the inner product of floor(scale * x), exact while below 2**53. Vectors that are null, empty or hold null or
    non-finite components take no part, nor do rows without an id; a query meets candidates of its own length. Rows of one id are candidates
    each, and so are queries of one id, whose results are ranked together. Groups of candidates meet blocks of queries, so a task holds one of each; a group's best k
    are merged per query. Further columns are ignored.
    """
    partial = found_by_group(rows, queries, k=k, id_col=id_col, vector_col=vector_col, scale=scale)
    ranked = partial.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
