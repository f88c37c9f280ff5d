"""Periodic runs of words, found with a dictionary of basic factors.

Level k names every factor of 2^k words of a document.  Occurrences of one factor that follow each other within twice its
length lie in an arithmetic progression, whose step is a period: where a factor at word i comes again at i + q and i + 2q, and nowhere
between, the 2q + 2^k words from i on have period q.  Level k proposes the periods above 2^(k-1) up to 2^k, so each run is
proposed on one level only; its proposals begin at its first word and are consecutive, hence a streak of them, extended to its end, is
the run, and no run comes twice.  Words whose factor comes only once in their document leave the dictionary, as no
longer factor that begins there can come again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import text as T

#: Words and periods that a run holds at least.
LEAST_WORDS = 6
LEAST_EXPONENT = 4

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) of all runs in the texts ``codes[bounds[i]:bounds[i + 1]]``, by text, start and period.

    A run is a stretch with smallest period q and at least max(LEAST_WORDS, LEAST_EXPONENT * q) words which neither neighbour extends.
    """
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    end, furthest = bounds[1:][text], sizes[text] // LEAST_EXPONENT
    at, names, width = np.arange(len(codes)), np.full(len(codes), -1, np.int64), 1
    keys = text * (int(codes.max()) + 1 if len(codes) else 1) + codes
    found = [np.zeros((0, 3), np.int64)]
    while len(at):
        order = np.argsort(keys, kind="stable")
        placed, ordered = at[order], keys[order]
        step = np.diff(placed)
        again = ordered[1:] == ordered[:-1]
        near = again & (step <= furthest[placed[:-1]])
        # Three occurrences in a progression whose step is a period of this level.
        first = np.flatnonzero(near[:-1] & near[1:] & (step[:-1] == step[1:]) & (step[:-1] <= width) & (2 * step[:-1] > width))
        found.append(streaks(placed[first], step[first], width))
        # The names of this level, for those factors that come again close enough.
        names[:] = -1
        held = np.zeros(len(placed), bool)
        held[1:] |= near
        held[:-1] |= near
        numbers = np.concatenate([[0], np.cumsum(~again)])
        names[placed[held]] = numbers[held]
        at = np.sort(placed[held])
        at = at[at + 2 * width <= end[at]]
        at = at[names[at + width] >= 0]
        keys = names[at] * (int(numbers[-1]) + 1) + names[at + width]
        width *= 2
    runs = np.concatenate(found)
    runs = runs[runs[:, 1] >= np.maximum(LEAST_WORDS, LEAST_EXPONENT * runs[:, 2])]
    own = text[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
    runs = np.column_stack([own, runs[:, 0] - bounds[own], runs[:, 1:]])
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def streaks(starts: np.ndarray, steps: np.ndarray, width: int) -> np.ndarray:
    """Rows (start, length, period): proposals at consecutive places with one period are one run."""
    if not len(starts):
        return np.zeros((0, 3), np.int64)
    order = np.argsort(starts)
    starts, steps = starts[order], steps[order]
    new = np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(steps) != 0)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    return np.column_stack([starts[first], starts[last] - starts[first] + 2 * steps[first] + width, steps[first]])


def repeated(runs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each word lies in a run, after the run's first period."""
    edge = np.zeros(int(bounds[-1]) + 1, np.int64)
    start = bounds[runs[:, 0]] + runs[:, 1]
    np.add.at(edge, start + runs[:, 3], 1)
    np.add.at(edge, start + runs[:, 2], -1)
    return np.cumsum(edge[:-1]) > 0


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cycle: Callable[[object, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """The periodic runs of words of each row of ``df``: the id, n_words, runs and collapsed.

    ``runs`` holds (start, length, period) by start, then period: each stretch of words ``[^\\x20\\x09-\\x0D]+`` with smallest period q and
    max(LEAST_WORDS, LEAST_EXPONENT * q) words or more that can't be extended.  ``collapsed`` is the text without the words
    that a run holds after its first q, joined by single spaces.  ``cycle``, given an id and a number of words, may name a word a and a
    period p: words from a on then are first replaced by the p words from a on, again and again (for tests of recall).  A null, empty or
    blank text has no words and no runs; rows that repeat an id or have none are rows of their own; an empty table gives an empty
    result.  A task holds about T.SLICE_BYTES of texts, or one longer text, at a time.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches):
            flat, bounds = T.words(b.column("text"))
            codes, _ = T.coded(flat)
            taken = np.arange(len(flat))
            if cycle:
                for key, a, e in zip(b.column("id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    if made := cycle(key, e - a):
                        taken[a + made[0] : e] = a + made[0] + np.arange(e - a - made[0]) % made[1]
            runs = find_runs(codes.astype(np.int64)[taken], bounds)
            kept = ~repeated(runs, bounds)
            left = np.concatenate([[0], np.cumsum(kept)])[bounds].astype(np.int32)
            own = np.searchsorted(runs[:, 0], np.arange(len(bounds))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(own), pa.StructArray.from_arrays([pa.array(runs[:, i].copy()) for i in (1, 2, 3)], fields=list(RUN)))
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(left), flat.take(pa.array(taken[kept]))), " ")
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(bounds)), lists, texts], ["id", "n_words", "runs", "collapsed"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(search, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumnRenamed("id", id_col)
