"""Token ids in Arrow files of fixed-size-list batches: equal-length sequences with masks, readable in place."""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import scratch
from lumenframe.llm import text as T
from lumenframe.llm.tokens import Encoder, default_tokenizer

#: Bytes of text for each file at most, about; small inputs have a file for each reducer.
FILE_BYTES = 256 << 20
#: Ids in a sequence, and sequences in a record batch.
LENGTH = 2048
BATCH = 128


def file_schema(id_type: pa.DataType, length: int = LENGTH) -> pa.Schema:
    """``ids``: the sequence, padded with 0 at the end of a file; ``mask``: true where an id is real."""
    return pa.schema([pa.field("ids", pa.list_(id_type, length)), pa.field("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Cuts a stream of ids into sequences and writes them batch by batch."""

    def __init__(self, sink: pa.NativeFile, id_type: pa.DataType, length: int = LENGTH) -> None:
        self.schema, self.length, self.dtype = file_schema(id_type, length), length, id_type.to_pandas_dtype()
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.rest: list[np.ndarray] = []
        self.held = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids.astype(self.dtype))
        self.held += len(ids)
        self.total += len(ids)
        step = self.length * BATCH
        if self.held >= step:
            flat = np.concatenate(self.rest)
            full = len(flat) // step * step
            for at in range(0, full, step):
                self._batch(flat[at : at + step], step)
            self.rest, self.held = [flat[full:]], len(flat) - full

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        lists = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(ids), mask)]
        self.writer.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        flat = np.concatenate([*self.rest, np.zeros(0, self.dtype)])
        if len(flat):
            pad = -len(flat) % self.length
            self._batch(np.concatenate([flat, np.zeros(pad, self.dtype)]), len(flat))
        self.writer.close()


class SequenceFile:
    """Random access to a file: sequences and masks are views of the mapped file."""

    def __init__(self, path: str) -> None:
        system, at = pafs.FileSystem.from_uri(path)
        local = isinstance(system, pafs.LocalFileSystem)
        self.source = pa.memory_map(at) if local else system.open_input_file(at)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.step = self.length * BATCH
        self._last: tuple[int, np.ndarray] | None = None

    def batch(self, k: int) -> np.ndarray:
        """The ids of record batch ``k`` in a row, without a copy where the file is mapped."""
        if self._last is None or self._last[0] != k:
            self._last = k, self.reader.get_batch(k).column("ids").values.to_numpy(zero_copy_only=True)
        return self._last[1]

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``k``."""
        b = self.reader.get_batch(k // BATCH)
        return b.column("ids")[k % BATCH].values.to_numpy(), b.column("mask")[k % BATCH].values.to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start`` on, across sequences and batches."""
        parts = []
        while n:
            own = self.batch(start // self.step)
            part = own[start % self.step : start % self.step + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, np.uint16)])


def write_tokens(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                 end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """Encode all texts and write them in ascending order of id, one file for each range of ids.

    Null texts count as empty: the end id alone.  Null ids come first; rows of equal id are in the order
    of their texts.  The result is the index, stored beside the files: part, file, at, id, start (in
    the file), n_tokens.  Only files of finished tasks are in the index; a repeated task writes another file.
    """
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType.simpleString()
    path = tokenizer or default_tokenizer()
    ids = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    files = max(scratch.partitions(spark), math.ceil((ids.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / FILE_BYTES))
    ordered = ids.repartitionByRange(files, "id").sortWithinPartitions("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder.of(path), TaskContext.get()
        small = pa.uint16() if encoder.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else pa.uint32()
        part = task.partitionId()
        system, at = pafs.FileSystem.from_uri(folder)
        system.create_dir(at, recursive=True)
        name = f"part-{part:06d}-{task.taskAttemptId()}.arrow"
        out = None
        for b in T.slices(batches):
            if out is None:
                sink = system.open_output_stream(f"{at}/{name}")
                out = SequenceWriter(sink, small, length)
            tokens, bounds = encoder.ids(b.column("text"), end_id)
            start = bounds[:-1] + out.total
            out.add(tokens)
            n = len(start)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part)), pa.array([f"{folder}/{name}"] * n, pa.string()), b.column("id"), pa.array(start), pa.array(np.diff(bounds))],
                ["part", "file", "id", "start", "n_tokens"])
        if out is not None:
            out.close()
            sink.close()

    return scratch.table(ordered.mapInArrow(write, f"part long, file string, id {id_type}, start long, n_tokens long"), "token-index")


def read_tokens(index: DataFrame) -> DataFrame:
    """Read the files of an index back: id, start (ids of all documents before), n_tokens, ids_crc32."""
    sizes = sorted(index.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # a row for each file
    before = list(itertools.accumulate((n for _, n in sizes), initial=0))
    offsets = index.sparkSession.createDataFrame([(part, at) for (part, _), at in zip(sizes, before, strict=False)], "part long, before long")
    id_type = index.schema["id"].dataType.simpleString()
    dealt = index.join(offsets, "part").repartition(max(scratch.partitions(index.sparkSession), len(sizes)), "part").sortWithinPartitions("part", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for b in batches:
            crc = []
            for path, start, n in zip(*(b.column(c).to_pylist() for c in ("file", "start", "n_tokens")), strict=True):
                if path != name:
                    name, file = path, SequenceFile(path)
                crc.append(zlib.crc32(file.ids(start, n).astype("<u4")))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(b.column("before").to_numpy() + b.column("start").to_numpy()), b.column("n_tokens"), pa.array(crc, pa.int64())],
                ["id", "start", "n_tokens", "ids_crc32"])

    return dealt.mapInArrow(read, f"id {id_type}, start long, n_tokens long, ids_crc32 long")


def token_files(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Write all documents to token files in the shared folder and read them back, a row for each document.

    See ``write_tokens`` for nulls, ties and order.  An empty table gives no file and an empty result.
    """
    folder = scratch.new_path(df.sparkSession, "tokens")
    index = write_tokens(df, folder, id_col, text_col, tokenizer, end_id)
    return read_tokens(index).withColumnRenamed("id", id_col)
