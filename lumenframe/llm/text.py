"""Arrow helpers that the text operators share; they work on one bounded slice of a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: UTF-8 bytes of text that a task holds as words at one time (a longer document is a slice of its own).
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``limit`` bytes of ``column``, or one row; nulls there become empty."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        batch = batch.set_column(at, column, pc.fill_null(batch.column(at).cast(pa.string()), ""))
        ends = np.cumsum(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()  # workers are kept for other tasks, what this one took needn't be


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of all texts in a row, and the offsets of each text in them."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    there = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return flat.filter(there), kept[bounds]


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of the values, and the distinct values."""
    d = values.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    if not len(ends):
        return np.zeros(0, np.int64)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])


class Remembered:
    """What has been made of texts, up to a number of bytes; then it starts anew.  Long texts aren't remembered."""

    def __init__(self, most: int = 64 << 20, longest: int = 256) -> None:
        self.most, self.longest, self.held, self.known = most, longest, 0, {}

    def parts(self, values: list[str], made: Callable[[list[str]], Iterable[bytes]]) -> list[bytes]:
        """The bytes of each of the distinct values; those that aren't known are made, in one go."""
        if self.held > self.most:
            self.known, self.held = {}, 0
        out = list(map(self.known.get, values))
        new = [i for i, p in enumerate(out) if p is None]
        for i, p in zip(new, made([values[i] for i in new]), strict=True):
            out[i] = p
            if len(values[i]) <= self.longest:
                self.known[values[i]] = p
                self.held += 200 + 4 * len(values[i]) + len(p)  # objects and table too
        return out
