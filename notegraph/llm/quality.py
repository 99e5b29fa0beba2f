"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded (hashed byte pairs and
character-class triples, then a dense layer), gated attention weighs the passages, and a logistic unit
scores the weighted representation. Only document labels are used; the weights on passages are learned.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.llm.common import forget, quoted, small_batches, stored

PASSAGE = 512  # bytes
PAIRS, TRIPLES = 256, 512
FEATURES = PAIRS + TRIPLES
#: The bound of the training sample: documents of each label. All their passages are read, in training as in scoring.
SAMPLE_EACH = 2000
#: Bytes of a text, and passages of a training batch, that are encoded at a time.
CHUNK, PASSAGES = 1 << 20, 1 << 12
#: Steps of training, and parts of the sample whose gradients are summed side by side.
STEPS, TRAINERS = 60, 16


def _classes() -> np.ndarray:
    """Character class of each byte: lower case, upper case, digit, space, line end, bytes beyond ASCII; each punctuation mark is its own."""
    kind = np.arange(256)
    kind[ord("a") : ord("z") + 1] = ord("a")
    kind[ord("A") : ord("Z") + 1] = ord("A")
    kind[ord("0") : ord("9") + 1] = ord("0")
    kind[128:] = ord("a")
    return kind.astype(np.uint32)


CLASS = _classes()


def counts(data: np.ndarray) -> np.ndarray:
    """Feature counts of data's passages, a row each; no data: one empty passage."""
    n = max(1, -(-len(data) // PASSAGE))
    b = data.astype(np.uint32)
    c = CLASS[data]
    out = np.zeros(n * FEATURES, np.int64)
    if len(b) > 1:
        pair = ((b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)) >> np.uint32(11)) % np.uint32(PAIRS)
        out += np.bincount((np.arange(len(pair)) // PASSAGE) * FEATURES + pair, minlength=len(out))
    if len(c) > 2:
        triple = ((c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(9)) % np.uint32(TRIPLES)
        out += np.bincount((np.arange(len(triple)) // PASSAGE) * FEATURES + PAIRS + triple, minlength=len(out))
    return out.reshape(n, FEATURES)


def scaled(found: np.ndarray) -> np.ndarray:
    """Logs of counts at the rate of a full passage, so that a short last passage compares."""
    total = np.maximum(found[:, :PAIRS].sum(axis=1, keepdims=True), 32)
    return np.log1p(found * (PASSAGE / total)).astype(np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Gated attention over passages: weights of the encoder (w, b), the gates (v, u), the attention (a) and the score (c, d)."""

    mean: np.ndarray
    std: np.ndarray
    p: dict[str, np.ndarray]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each passage's representation and attention logit."""
        h = np.maximum((x - self.mean) / self.std @ self.p["w"] + self.p["b"], 0)
        return h, (np.tanh(h @ self.p["v"]) * _sigmoid(h @ self.p["u"])) @ self.p["a"]

    def score(self, data: np.ndarray) -> float:
        """A whole text's score; long texts pass in chunks, whose softmax sums are carried along."""
        top, weight, total = -np.inf, 0.0, np.zeros(self.p["w"].shape[1])
        for at in range(0, max(1, len(data)), CHUNK):
            h, e = self.encode(scaled(counts(data[at : at + CHUNK])))
            new = max(top, float(e.max()))
            shrink, part = np.exp(top - new), np.exp(e - new)
            weight, total, top = weight * shrink + part.sum(), total * shrink + part @ h, new
        return float(_sigmoid(total / weight @ self.p["c"] + self.p["d"][0]))


def packed_bag(data: np.ndarray) -> list[bytes]:
    """A text's passage counts, compressed, a CHUNK of the text at a time."""
    return [zlib.compress(counts(data[at : at + CHUNK]).astype(np.uint16).tobytes(), 1) for at in range(0, max(1, len(data)), CHUNK)]


def unpacked(bag: Iterable[bytes]) -> Iterator[np.ndarray]:
    """Scaled features of a packed bag's passages, a chunk at a time."""
    for chunk in bag:
        yield scaled(np.frombuffer(zlib.decompress(chunk), np.uint16).reshape(-1, FEATURES).astype(np.int64))


@dataclass
class Bag:
    """A document's passages, read anew at each call of parts(), their number, and the document's label and weight."""

    parts: Callable[[], Iterable[np.ndarray]]
    size: int
    label: float
    weight: float


def _batches(bags: Iterable[Bag]) -> Iterator[list[Bag]]:
    """Bags in order, with at most PASSAGES passages together; a longer one stands alone."""
    held, n = [], 0
    for bag in bags:
        if held and n + bag.size > PASSAGES:
            yield held
            held, n = [], 0
        held.append(bag)
        n += bag.size
    if held:
        yield held


def _passages(bags: list[Bag]) -> Iterator[tuple[slice, np.ndarray]]:
    """The passages of all bags, in order, at most PASSAGES at a time, with their places."""
    at, held, n = 0, [], 0
    for bag in bags:
        for rows in bag.parts():
            while len(rows):
                part, rows = rows[: PASSAGES - n], rows[PASSAGES - n :]
                held.append(part)
                n += len(part)
                if n == PASSAGES:
                    yield slice(at, at + n), np.concatenate(held)
                    at, held, n = at + n, [], 0
    if n:
        yield slice(at, at + n), np.concatenate(held)


def moments(bags: Iterable[Bag]) -> np.ndarray:
    """Over all passages: sums of each feature, of its square, and their number; with the bags' weights summed, last."""
    out = np.zeros(2 * FEATURES + 2)
    for batch in _batches(bags):
        for _, x in _passages(batch):
            out[:-1] += np.concatenate([x.sum(axis=0, dtype=np.float64), (x.astype(np.float64) ** 2).sum(axis=0), [len(x)]])
        out[-1] += sum(b.weight for b in batch)
    return out


def gradient(bags: Iterable[Bag], model: Model) -> np.ndarray:
    """The weighted loss' gradient by all parameters, flat, summed over the bags. What is held follows PASSAGES, not the bags."""
    p, total = model.p, {k: np.zeros(x.shape) for k, x in model.p.items()}
    for part in _batches(bags):
        size = np.array([b.size for b in part])
        start, of = np.concatenate([[0], np.cumsum(size)[:-1]]), np.repeat(np.arange(len(part)), size)

        def encoded(part=part):
            """Chunks of the batch's passages: their slice, features, representations and gates."""
            for where, x in _passages(part):
                x = (x - model.mean) / model.std
                h = np.maximum(x @ p["w"] + p["b"], 0)
                yield where, x, h, np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])

        chunks = list(encoded()) if size.sum() <= PASSAGES else None  # a longer bag is encoded anew for each sum, so that a chunk is held at a time
        e = np.concatenate([(g1 * g2) @ p["a"] for _, _, _, g1, g2 in chunks or encoded()])
        e = np.exp(e - np.maximum.reduceat(e, start)[of])
        att = e / np.add.reduceat(e, start)[of]
        z = np.zeros((len(part), len(p["c"])))
        for where, _, h, _, _ in chunks or encoded():
            np.add.at(z, of[where], att[where, None] * h)
        g = (_sigmoid(z @ p["c"] + p["d"]) - np.array([b.label for b in part])) * np.array([b.weight for b in part])
        dz = (g[:, None] * p["c"]).astype(np.float32)
        mid = (z * dz).sum(axis=1).astype(np.float32)  # of each bag, what attention gives back on average
        total["c"] += z.T @ g
        total["d"] += g.sum(keepdims=True)
        for where, x, h, g1, g2 in chunks or encoded():
            o, w = of[where], att[where]
            de = w * ((h * dz[o]).sum(axis=1) - mid[o])
            dg = de[:, None] * p["a"]
            d1, d2 = dg * g2 * (1 - g1**2), dg * g1 * g2 * (1 - g2)
            dh = (w[:, None] * dz[o] + d1 @ p["v"].T + d2 @ p["u"].T) * (h > 0)
            for k, x_k in (("w", x.T @ dh), ("b", dh.sum(axis=0)), ("v", h.T @ d1), ("u", h.T @ d2), ("a", (g1 * g2).T @ de)):
                total[k] += x_k
    return np.concatenate([total[k].ravel() for k in p])


def descend(summed: Callable[[Callable[[Iterator[Bag]], np.ndarray]], np.ndarray], *, hidden: int = 32, gates: int = 16, steps: int = STEPS, rate: float = 2e-2, seed: int = 7) -> Model:
    """Trains by Adam on whole gradients. summed(f): f's sums over all bags, wherever they are."""
    sums = summed(moments)
    n, weight = sums[-2], sums[-1]
    mean = sums[:FEATURES] / n
    std = np.sqrt(np.maximum(sums[FEATURES : 2 * FEATURES] / n - mean**2, 0)) + 0.1
    rng = np.random.default_rng(seed)
    init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    p = {"w": init(FEATURES, hidden), "b": np.zeros(hidden), "v": init(hidden, gates), "u": init(hidden, gates), "a": init(gates), "c": init(hidden) * 0.1, "d": np.zeros(1)}
    m, s = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    now = lambda: Model(mean.astype(np.float32), std.astype(np.float32), {k: x.astype(np.float32) for k, x in p.items()})
    for t in range(1, steps + 1):
        model = now()
        flat, at = summed(lambda bags, model=model: gradient(bags, model)) / weight, 0
        for k in p:
            g = flat[at : at + p[k].size].reshape(p[k].shape) + (1e-4 * p[k] if k in "wc" else 0)
            at += p[k].size
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.999 * s[k] + 0.001 * g**2
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return now()


def _bytes(text) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def bags(docs: DataFrame, chosen: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, label, passages, bag) of the chosen documents (labelled, label): all their passages, packed. Of rows that share an id, the least bag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = _bytes(text)
                yield pa.RecordBatch.from_arrays([pa.array([doc]), pa.array([label], pa.int32()), pa.array([_passage_count(len(data))]), pa.array([packed_bag(data)], pa.list_(pa.binary()))], ["doc_id", "label", "passages", "bag"])

    read = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
    rows = read.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, passages long, bag array<binary>")
    return rows.repartition(TRAINERS, "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("passages", "bag")).alias("b")).select("doc_id", "label", "b.*")


def _passage_count(size: int) -> int:
    """Passages of a text of so many bytes, CHUNK by CHUNK."""
    return max(1, sum(-(-min(CHUNK, size - at) // PASSAGE) for at in range(0, size, CHUNK)))


def _summed(sample: DataFrame, share: dict[int, float]) -> Callable[[Callable[[Iterator[Bag]], np.ndarray]], np.ndarray]:
    """Sums over a table of bags: each task sums its own, and only its sums reach the driver."""

    def over(f):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = (Bag(lambda bag=bag: unpacked(bag), n, float(y), share[y]) for batch in batches for y, n, bag in zip(*(c.to_pylist() for c in batch.columns), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([f(found).tobytes()], pa.binary())], ["sums"])

        return sum(np.frombuffer(r["sums"], np.float64) for r in sample.select("label", "passages", "bag").mapInArrow(run, "sums binary").collect())

    return over


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", each: int = SAMPLE_EACH, **options) -> Model | None:
    """A model from the labelled documents; None where there are none.

    At most `each` documents of either label are used, the first by hash of their ids, weighted by the label's count among all labels; each with all its passages.
    Their features stay in a stored table, whose tasks sum the gradients of each step; the driver sees sums alone, however long the texts are. Sums of other
    splits of that table differ by rounding. Labels other than 0 and 1 and null ids are ignored; a document's repeated labels count as their least.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("labelled")).agg(F.min(label_col).cast("int").alias("label"))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    some = [r for y in (0, 1) for r in known.filter(F.col("label") == y).orderBy(F.xxhash64("labelled"), "labelled").limit(each).collect()]
    if not some:
        return None
    chosen = spark.createDataFrame(some, "labelled long, label int")  # 2 * each rows at most
    sample = stored(bags(docs, chosen, id_col=id_col, text_col=text_col), "bags")
    found = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    model = descend(_summed(sample, {k: totals[k] / n for k, n in found.items()}), **options) if found else None
    forget(sample)
    return model


def score(docs: DataFrame, model: Model | None, *, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """docs with a column score_col, from 0 to 1; every passage of every text is read, and nothing else of a row.

    Null texts score as empty ones. Without a model every score is 1. Rows, nulls and further columns stay; a column score_col is replaced. No shuffle.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([1.0 if model is None else model.score(_bytes(t)) for t in part], dtype=float)

    return docs.withColumn(score_col, scores(F.col(quoted(text_col)).cast("string")))


def held_out(doc_id):
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
