"""Packing of documents into training sequences of even attention cost.

A piece of n tokens costs ``linear * n + quadratic * n * n``: attention stays inside a piece.
Pieces are taken in descending length; each goes to the sequence of the lowest cost so far that
has room for it.  Where none has, the piece is cut at the roomiest one.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loopwright.llm.common import give_back
from loopwright.llm.tokens import vocabulary_path, word_tokenizer

CAPACITY = 2048
# Tokens of short pieces that are packed together; what a task holds at a time.
GROUP_TOKENS = 1 << 20
# Cost of a token and of a pair of tokens that attend to each other (a model of width 1024:
# per layer about 12 * width multiplications a token and 2 a pair, in units of width).
LINEAR, QUADRATIC = 12.0, 2.0 / 1024

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, cost double"
)


def cost(length, linear: float = LINEAR, quadratic: float = QUADRATIC):
    return linear * length + quadratic * length * length


def capacities_of(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Sequence sizes that hold exactly so many tokens: full ones, the rest in powers of two."""
    rest = tokens % capacity
    return [capacity] * (tokens // capacity) + [
        1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1
    ]


def assign(
    lengths: list[int], sizes: list[int], linear: float = LINEAR, quadratic: float = QUADRATIC
) -> list[tuple[int, int, int, int, int]]:
    """Place pieces in sequences: (piece, start in it, length, sequence, offset) rows.

    ``sizes`` add up to the lengths' sum.  Ties: the longer piece, then the earlier; the lowest
    sequence number.
    """
    heap = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(heap)
    room = np.array(sizes, dtype=np.int64)
    load = np.zeros(len(sizes))
    size, placed = np.array(sizes, dtype=np.int64), []
    while heap:
        n, i, start = heapq.heappop(heap)
        n = -n
        fits = room >= n
        if fits.any():
            s, take = int(np.argmin(np.where(fits, load, np.inf))), n
        else:
            s = int(np.argmax(room))
            take = int(room[s])
            heapq.heappush(heap, (-(n - take), i, start + take))
        placed.append((i, start, take, s, int(size[s] - room[s])))
        room[s] -= take
        load[s] += cost(take, linear, quadratic)
    return placed


class _Packer:
    """Collects the documents of a task and gives out packed groups of bounded size."""

    def __init__(self, base: int, capacity: int, group: int, linear: float, quadratic: float):
        self.next, self.capacity, self.group = base, capacity, group
        self.weights = linear, quadratic
        self.short: list[tuple] = []  # doc_id, start, ids, tokens of the document
        self.held = 0
        self.rows: list[tuple] = []

    def _row(self, doc, start, ids, total, sequence, offset) -> None:
        n = len(ids)
        self.rows.append(
            (doc, start, n, zlib.crc32(ids.tobytes()), total, sequence, offset,
             float(cost(n, *self.weights)))
        )

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, whole = len(ids), len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            self._row(doc, start, ids[start : start + self.capacity], total, self.next, 0)
            self.next += 1
        if whole < total:
            self.short.append((doc, whole, ids[whole:], total))
            self.held += total - whole
        if self.held >= self.group:
            self.pack(last=False)

    def pack(self, last: bool) -> None:
        """Pack what is held into full sequences; what is over waits, at the end it is packed too."""
        over, kept = (0 if last else self.held % self.capacity), []
        while over:
            doc, start, ids, total = self.short.pop()
            if len(ids) > over:
                self.short.append((doc, start, ids[: len(ids) - over], total))
                start, ids = start + len(ids) - over, ids[len(ids) - over :]
            kept.append((doc, start, ids, total))
            over -= len(ids)
        sizes = capacities_of(sum(len(p[2]) for p in self.short), self.capacity)
        for i, at, n, s, offset in assign([len(p[2]) for p in self.short], sizes, *self.weights):
            doc, start, ids, total = self.short[i]
            self._row(doc, start + at, ids[at : at + n], total, self.next + s, offset)
        self.next += len(sizes)
        self.short = kept[::-1]
        self.held = sum(len(p[2]) for p in kept)

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [[] for _ in schema]
        self.rows = []
        return pa.record_batch(
            [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
        )


def pack_documents(
    docs: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 1,
    capacity: int = CAPACITY,
    group_tokens: int = GROUP_TOKENS,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
) -> DataFrame:
    """One row a piece: where its ids come from and where they stand.

    Every id of every document (its text's ids, then ``end_id``; NULL and empty texts have only
    that) lies in exactly one piece.  Sequences hold ``capacity`` ids; the last ones of a task
    are powers of two, so nothing is padded.  Full stretches of long documents are sequences of
    their own.  Repeated rows are packed like any others; NULL ids stay NULL; an empty table gives
    no rows.  Other columns are ignored.

    Each task packs its own documents, in groups of bounded size: nothing is shuffled, and no
    group is larger than ``group_tokens`` and one document's tokens.  Sequence numbers hold the task's number in the
    upper bits.  Write the rows before shuffling them: a task that is run again over rows that
    came in another order packs them differently, though always whole.
    """
    path = vocabulary_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(path).encode
        packer = _Packer(
            TaskContext.get().partitionId() << 40, capacity, group_tokens, linear, quadratic
        )
        schema = pa.schema(
            [(n, pa.float64() if k == "double" else pa.int64())
             for n, k in (c.split() for c in SCHEMA.split(", "))]
        )
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for doc, text in zip(ids, texts):
                (made,) = encode([text.as_py()])
                packer.add(doc, np.concatenate([made, end]))
            yield packer.batch(schema)
        packer.pack(last=True)
        yield packer.batch(schema)
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
