"""NPY arrays by ranges of rows: a data source that reads the header of a file and the bytes of the rows that a task takes.

``spark.read.format("npy_rows")`` with options ``path``, ``glob`` and ``columns`` (places in a flat row, all if not given).  Filters on ``path`` choose files,
and bounds on ``row`` choose ranges, before anything is read.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from lumenframe.sources import ranges as R

SCHEMA = "path string, shape array<long>, row long, values array<double>"
BAD = (ValueError, EOFError, OSError, TypeError)
#: Tasks of fewer bytes than R.TASK_BYTES are made larger where there would be more than about so many.
MOST_TASKS = 1024


@dataclass
class Header:
    shape: tuple
    fortran: bool
    dtype: np.dtype
    start: int

    @property
    def rows(self) -> int:
        return self.shape[0] if self.shape else 1

    @property
    def width(self) -> int:
        return math.prod(self.shape[1:])


def header(f: pa.NativeFile, length: int) -> Header:
    """What the file says of its array; an error if that can't be read or doesn't fit the file's length."""
    f.seek(0)
    head = f.read(12)
    size = 10 + int.from_bytes(head[8:10], "little") if head[6:7] == b"\x01" else 12 + int.from_bytes(head[8:12], "little")
    f.seek(0)
    data = io.BytesIO(f.read(min(size, length)))
    version = np.lib.format.read_magic(data)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(data)
    found = Header(shape, fortran, dtype, data.tell())
    if dtype.kind not in "biuf" or found.start + math.prod(shape) * dtype.itemsize > length:
        raise ValueError("no array of numbers of this length")
    return found


def rows_of(f: pa.NativeFile, h: Header, first: int, stop: int) -> np.ndarray:
    """The rows, each flat in C order, as doubles; only their bytes are read."""

    def numbers(at: int, n: int) -> np.ndarray:
        f.seek(h.start + at * h.dtype.itemsize)
        data = f.read(n * h.dtype.itemsize)
        if len(data) < n * h.dtype.itemsize:
            raise EOFError("the file ends early")
        return np.frombuffer(data, h.dtype)

    if not h.fortran:
        return numbers(first * h.width, (stop - first) * h.width).reshape(stop - first, h.width).astype(np.float64)
    columns = np.stack([numbers(c * h.rows + first, stop - first) for c in range(h.width)], axis=1) if h.width else np.zeros((stop - first, 0))
    return columns.reshape(stop - first, *h.shape[1:], order="F").reshape(stop - first, h.width).astype(np.float64)


@dataclass
class Pieces(InputPartition):
    #: (file, its length, first row, row after the last one or None for all)
    pieces: list


class NpyReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.glob, self.most = options["path"], options.get("glob", "*.npy"), int(options.get("taskbytes", R.TASK_BYTES))
        self.columns = [int(c) for c in options["columns"].split(",")] if options.get("columns") else None
        self.tests: dict[str, list] = {"path": []}
        self.first, self.stop = 0, math.inf

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in R.taken(filters, self.tests):
            if getattr(f, "attribute", None) == ("row",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                low = f.value + isinstance(f, GreaterThan) if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) else 0
                high = f.value + (not isinstance(f, LessThan)) if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) else math.inf
                self.first, self.stop = max(self.first, low), min(self.stop, high)
            yield f  # bounds of rows are tested by Spark too, as a bad file has a row without a number

    def partitions(self) -> Sequence[InputPartition]:
        small, out = [], []
        files = [(path, length) for path, length in R.files_below(self.root, self.glob) if R.passes(path, self.tests["path"])]
        most = max(self.most, min(R.TASK_BYTES, sum(length for _, length in files) // MOST_TASKS))
        for path, length in files:
            try:
                if length <= most:
                    raise ValueError("small enough for one task")
                system, at = R.located(path)
                with system.open_input_file(at) as f:
                    h = header(f, length)
                step = max(1, most // max(1, h.width * h.dtype.itemsize))
                first, stop = int(min(self.first, h.rows)), int(min(self.stop, h.rows))
                out += [Pieces([(path, length, i, min(i + step, stop))]) for i in range(first, stop, step)]
            except BAD:
                small.append(((path, length, 0, None), min(length, most)))
        return [*out, *(Pieces(p) for p in R.packed(small, most))]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        def batch(path: str, shape: tuple | None, numbers: np.ndarray | None, values: np.ndarray | None) -> pa.RecordBatch:
            n = 1 if numbers is None else len(numbers)
            lists = pa.nulls(n, pa.list_(pa.float64())) if values is None else pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))
            return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([None if shape is None else list(shape)] * n, pa.list_(pa.int64())), pa.nulls(1, pa.int64()) if numbers is None else pa.array(numbers), lists], ["path", "shape", "row", "values"])

        for path, length, first, stop in partition.pieces:
            try:
                system, at = R.located(path)
                with system.open_input_file(at) as f:
                    h = header(f, length)
                    start, end = (int(min(self.first, h.rows)), int(min(self.stop, h.rows))) if stop is None else (first, stop)
                    step = max(1, R.CHUNK // max(1, 8 * h.width))
                    for i in range(start, end, step):
                        values = rows_of(f, h, i, min(i + step, end))
                        yield batch(path, h.shape, np.arange(i, i + len(values)), values if self.columns is None else values[:, self.columns])
            except BAD:
                yield batch(path, None, None, None)


class NpyRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_rows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> NpyReader:
        return NpyReader(self.options)


def npy_rows(spark: SparkSession, root: str, glob: str = "*.npy", columns: list[int] | None = None, task_bytes: int = R.TASK_BYTES) -> DataFrame:
    """path, shape, row and values (a flat row) of the NPY files below ``root``; a file that can't be read is one row of nulls.

    Arrays of any size are read by several tasks, each of which holds about R.CHUNK bytes of doubles, or one row.  An array without dimensions is one row.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NpyRows)
    return spark.read.format("npy_rows").options(path=root, glob=glob, columns=",".join(map(str, columns or [])), taskbytes=str(task_bytes)).load()


def write_npy(df: DataFrame, folder: str) -> int:
    """Write ``df`` (file, place, values: arrays of numbers of one width in a file) as NPY arrays of doubles in ``folder``, rows by place; returns the number of files.

    A task writes its files one after the other, row by row under a header for the rows that are counted before, and moves each to its name when it is whole;
    a file whose rows aren't as many as were counted is an error.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = R.located(folder)
        system.create_dir(top, recursive=True)
        task = TaskContext.get()
        temporary, current, out, files = f"{top}/.npy-{task.partitionId()}-{task.taskAttemptId()}", None, None, 0
        said = written = 0

        def close() -> None:
            if out:
                out.close()
                if written != said:
                    system.delete_file(temporary)
                    raise ValueError(f"{current} has {written} of its {said} rows in one task")
                system.move(temporary, f"{top}/{current}")

        for b in batches:
            values = b.column("values")
            for i, (name, n) in enumerate(zip(b.column("file").to_pylist(), b.column("n").to_pylist(), strict=True)):
                row = np.asarray(values[i].values.to_numpy(zero_copy_only=False), "<f8")
                if name != current:
                    close()
                    current, out, width, files, said, written = name, system.open_output_stream(temporary), len(row), files + 1, n, 0
                    head = io.BytesIO()
                    np.lib.format.write_array_header_1_0(head, {"descr": "<f8", "fortran_order": False, "shape": (n, width)})
                    out.write(head.getvalue())
                if len(row) != width:
                    raise ValueError(f"{name} has rows of {width} and {len(row)} numbers")
                out.write(row.tobytes())
                written += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([files])], ["files"])

    counts = df.groupBy("file").agg(F.count("*").alias("n"))
    rows = df.select("file", "place", F.col("values").cast("array<double>").alias("values")).join(counts, "file")
    # Dealt by the count too: a shuffle by the file alone is dropped in favour of the join's own, which Spark reads by mapper once it sees that the counts are few.
    return rows.repartition("file", "n").sortWithinPartitions("file", "place").mapInArrow(write, "files long").agg(F.sum("files")).first()[0] or 0
