"""Best-fit-decreasing packing of token pieces into windows of fixed length."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import text as T
from lumenframe.llm.tokens import SLICE_BYTES, Encoder, default_tokenizer

WINDOW = 4096
#: Documents whose pieces one task packs; windows are never shared by tasks.
PACKED_TOGETHER = 16_000

PIECE = "start long, length long, ids_crc32 long, doc_tokens long"


class OpenWindows:
    """Open windows by remaining room: a segment tree of counts finds the tightest that fits in log(size) steps."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(self.leaves)]

    def put(self, window: int, room: int) -> None:
        self.open[room].append(window)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room of at least ``need``, and that room; it is open no longer."""
        count, node = self.count, need + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return self.open[room].pop(), room


class BestFit:
    """Places lengths, given in decreasing order, one after the other."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window, self.tree, self.made = window, OpenWindows(window), 0

    def place(self, n: int) -> tuple[int, int]:
        """(window number, offset) of a piece of length ``n``."""
        found = self.tree.take(n)
        if found is None:
            found, self.made = (self.made, self.window), self.made + 1
        number, room = found
        if room > n:
            self.tree.put(number, room - n)
        return number, self.window - room


def pieces(df: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """Full windows of each document and its rest: id, start, length, ids_crc32, doc_tokens."""
    id_type = df.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for b in T.slices(batches, limit=SLICE_BYTES):
            ids, bounds = encoder.ids(b.column("text"), end_id)
            n = np.diff(bounds)
            parts = -(-n // window)
            row = np.repeat(np.arange(len(n)), parts)
            start = T.ragged(np.zeros(len(n), np.int64), parts) * window
            length = np.minimum(window, n[row] - start)
            at = bounds[:-1][row] + start
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[row])],
                ["id", "start", "length", "ids_crc32", "doc_tokens"])
            pa.default_memory_pool().release_unused()  # else each worker keeps what its largest slice took

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, f"id {id_type}, {PIECE}")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2,
         window: int = WINDOW) -> DataFrame:
    """Pack all documents: one row for each piece with its sequence and the offset there.

    Every document is its ids plus ``end_id`` (a null or empty text: that id alone).  A document longer
    than ``window`` is first cut into full windows; the rests, longest first, go to the open window
    with the least room that holds them.  Each task packs the pieces of about PACKED_TOGETHER documents,
    chosen by hash, so a repeated run gives the same sequences.  Ties go by id, then start; rows that
    repeat an id are packed like any others, null ids too.  An empty table gives an empty result.
    """
    found = pieces(df, id_col, text_col, tokenizer or default_tokenizer(), end_id, window)
    groups = max(1, math.ceil(df.count() / PACKED_TOGETHER))
    dealt = found.repartition(groups, F.xxhash64("id", "start", "ids_crc32")).sortWithinPartitions(F.desc("length"), "id", "start", "ids_crc32")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        fit = BestFit(window)
        for b in batches:
            got = [fit.place(n) for n in b.column("length").to_pylist()]
            where = np.array(got, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(where[:, 0] + first), pa.array(where[:, 1])], [*b.schema.names, "sequence_id", "offset"])

    id_type = df.schema[id_col].dataType.simpleString()
    return dealt.mapInArrow(place, f"id {id_type}, {PIECE}, sequence_id long, offset long").withColumnRenamed("id", id_col)
