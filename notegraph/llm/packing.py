"""Hierarchical multi-length packing of documents into token sequences.

Documents are routed to context-size tiers by the tokens they still hold, each tier fills windows of
its own size, gaps in a long window take pieces of the shorter tiers, and the windows of a block are dealt to step groups
of like cost. The work of a task is one pass over its rows in blocks of bounded tokens, so nothing is
shuffled and a lost task is repeated alone.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.llm.common import quoted, small_batches

TIERS = (2048, 1024, 512, 256)
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
    " tier int, window_tokens int, step_group long"
)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 letters are themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_encoder(path: str):
    """The encoder of a byte-level tokenizer file. Its ids follow its merges' order, which makes them ranks; tiktoken's merge loop on them gives the ids that the tokenizers library gives, in a third of the time. The file's added tokens stand for their strings, as in the library."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocab, added = file["model"]["vocab"], file.get("added_tokens") or []
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take white space or whole words only are not supported")
    letters = byte_letters()
    ranks = {bytes(map(letters.__getitem__, t)): i for t, i in vocab.items() if all(c in letters for c in t)}
    special = {t["content"]: t["id"] for t in added}
    return tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks={k: v for k, v in ranks.items() if v not in special.values()}, special_tokens=special)


class Packer:
    """Packs documents of one task. add() takes them in order; rows come from flush()."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, group: int = 8, base: int = 0):
        self.tiers, self.group, self.next, self.base = tuple(sorted(tiers, reverse=True)), group, 0, base
        self.waiting: list[tuple] = []  # (doc_id, ids, start, length)
        self.tokens = 0
        self.groups = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.waiting.append((doc_id, ids, 0, len(ids)))
        self.tokens += len(ids)

    def _pieces_of(self, length: int) -> Iterable[int]:
        top = self.tiers[0]
        yield from [top] * (length // top)
        if length % top:
            yield length % top

    def flush(self, last: bool) -> list[tuple]:
        """Packs what waits. The pieces that fill no window of the shortest tier wait for the next block, or, at the last, end in one padded window."""
        top, low = self.tiers[0], self.tiers[-1]
        windows: list[tuple[int, list[tuple]]] = []
        lengths: list[int] = []  # of the routed pieces, ascending
        by: dict[int, deque] = {}

        def route(piece):
            n = piece[3]
            if n not in by or not by[n]:
                by[n] = deque()
                bisect.insort(lengths, n)
            by[n].append(piece)

        def take(at: int):
            n = lengths[at]
            piece = by[n].popleft()
            if not by[n]:
                lengths.pop(at)
            return piece

        for doc_id, ids, start, length in self.waiting:
            for n in self._pieces_of(length):
                if n == top:
                    windows.append((top, [(doc_id, ids, start, n)]))
                else:
                    route((doc_id, ids, start, n))
                start += n
        self.waiting, self.tokens = [], 0
        for tier, shorter in zip(self.tiers, (*self.tiers[1:], 0), strict=True):
            while lengths and lengths[-1] > shorter:
                first = take(len(lengths) - 1)
                held, gap = [first], tier - first[3]
                while gap and lengths:
                    at = bisect.bisect_right(lengths, gap) - 1
                    if at >= 0:  # the longest piece of the shorter tiers that fits whole
                        piece = take(at)
                        held.append(piece)
                        gap -= piece[3]
                    else:  # none fits: the shortest one is cut, what is left of it is routed again
                        doc_id, ids, start, n = take(0)
                        held.append((doc_id, ids, start, gap))
                        route((doc_id, ids, start + gap, n - gap))
                        gap = 0
                if gap == 0:
                    windows.append((tier, held))
                    continue
                rest = tier - gap  # nothing is left to fill it
                if not last:
                    self.waiting = held
                    self.tokens = rest
                    continue
                for size in self.tiers:  # whole windows of the shorter tiers, then one padded window
                    if rest >= size:
                        filled, need = [], size
                        while need:
                            doc_id, ids, start, n = held.pop(0)
                            k = min(n, need)
                            filled.append((doc_id, ids, start, k))
                            if k < n:
                                held.insert(0, (doc_id, ids, start + k, n - k))
                            need -= k
                        windows.append((size, filled))
                        rest -= size
                if rest:
                    windows.append((rest if rest & (rest - 1) == 0 and rest >= low else top, held))
        return self._rows(windows)

    def _rows(self, windows) -> list[tuple]:
        """Deals the windows to step groups: by falling cost (squared piece lengths, as attention within documents costs) in serpentine order, so each group gets as many windows of each rank."""
        if not windows:
            return []
        n_groups = -(-len(windows) // self.group)
        cost = [sum(p[3] ** 2 for p in held) for _, held in windows]
        place = {}
        for rank, at in enumerate(sorted(range(len(windows)), key=lambda i: (-cost[i], i))):
            lap, k = divmod(rank, n_groups)
            place[at] = k if lap % 2 == 0 else n_groups - 1 - k
        rows = []
        for at, (tier, held) in enumerate(windows):
            offset, held_tokens = 0, sum(p[3] for p in held)
            for doc_id, ids, start, n in held:
                crc = zlib.crc32(ids[start : start + n].tobytes())
                rows.append((doc_id, start, n, crc, len(ids), self.base + self.next, offset, tier, held_tokens, self.base + self.groups + place[at]))
                offset += n
            self.next += 1
        self.groups += n_groups
        return rows


def pack(docs: DataFrame, tokenizer_path: str, *, end_id: int = 1, tiers: tuple[int, ...] = TIERS, group: int = 8, block_tokens: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents, with the sequence and the place each has.

    Each document is its token ids and then end_id; every id lies in one piece. A task packs blocks of
    about block_tokens tokens and carries what fills no window into the next block, so its
    sequences are full but for the last. sequence_id is unique over tasks: the task's number, then a
    count. Null or empty text: one piece of end_id alone. A null id is kept. Repeated rows are packed as
    often as they occur. An empty table gives no rows. Other columns are ignored.
    tier is the sequence's length with padding: a power of two for a full window, else the largest tier.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = partial(byte_level_encoder(tokenizer_path).encode, allowed_special="all")
        packer = Packer(tiers, group, TaskContext.get().partitionId() << 36)

        def out(rows):
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, TYPES, strict=True)], NAMES)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.add(doc_id, np.array([*encode(text or ""), end_id], dtype="<u4"))
                if packer.tokens >= block_tokens and (rows := packer.flush(False)):
                    yield out(rows)
        if rows := packer.flush(True):
            yield out(rows)

    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text")).mapInArrow(run, SCHEMA)


NAMES = [x.split()[0] for x in SCHEMA.split(",")]
TYPES = [pa.int64()] * 7 + [pa.int32()] * 2 + [pa.int64()]
