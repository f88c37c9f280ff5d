"""ZIP archives by member: a data source that reads the directory of an archive and the ranges of the members that are asked for.

``spark.read.format("archive_members")`` with options ``path`` (a root), ``glob`` and ``contents``.  Archives are dealt to tasks by their size; a
large one is dealt to several tasks by runs of its members.  Filters on ``zip`` and ``member`` are tested before anything of a member is read.
"""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition

from lumenframe.sources import ranges as R

SCHEMA = "zip string, member string, size long, compressed long, content binary"

# Records of the format, and where its numbers stand.
END, END_64, END_64_PLACE, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
STORED, DEFLATED, UTF8, WIDE = 0, 8, 0x800, 0xFFFFFFFF


@dataclass
class Member:
    name: str
    method: int
    crc: int
    compressed: int
    size: int
    offset: int


def directory(f: pa.NativeFile, length: int) -> tuple[int, int, int, int]:
    """Number of members, place and size of the directory, and what all places are shifted by (where something stands before the archive)."""
    start = max(0, length - 65_557)
    f.seek(start)
    tail = f.read(length - start)
    at = tail.rfind(END)
    if at < 0 or len(tail) - at < 22:
        raise zipfile.BadZipFile("no end of directory")
    count, size, offset = struct.unpack_from("<HLL", tail, at + 10)
    ends = start + at
    if at >= 20 and tail[at - 20 : at - 16] == END_64_PLACE:
        f.seek(struct.unpack_from("<Q", tail, at - 12)[0])
        wide = f.read(56)
        if wide[:4] != END_64:
            raise zipfile.BadZipFile("no wide end of directory")
        count, size, offset = struct.unpack_from("<QQQ", wide, 32)
        return count, offset, size, 0
    shift = ends - size - offset
    return count, offset + shift, size, shift


def members(f: pa.NativeFile, length: int) -> Iterator[Member]:
    """The members in the order of the directory, of which about R.CHUNK bytes are held at a time."""
    count, at, left, shift = directory(f, length)
    held = b""

    def need(n: int) -> None:
        nonlocal held, at, left
        while len(held) < n:
            if not left:
                raise zipfile.BadZipFile("the directory ends early")
            f.seek(at)
            more = f.read(min(left, R.CHUNK))
            held, at, left = held + more, at + len(more), left - len(more)

    for _ in range(count):
        need(46)
        if held[:4] != ENTRY:
            raise zipfile.BadZipFile("no member where one should be")
        flags, method = struct.unpack_from("<HH", held, 8)
        crc, compressed, size, n_name, n_extra, n_note = struct.unpack_from("<LLLHHH", held, 16)
        offset = struct.unpack_from("<L", held, 42)[0]
        need(46 + n_name + n_extra + n_note)
        name, extra = held[46 : 46 + n_name], held[46 + n_name : 46 + n_name + n_extra]
        held = held[46 + n_name + n_extra + n_note :]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # wide numbers, each there only if its narrow place is full
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                size, compressed, offset = (next(wide) if x == WIDE else x for x in (size, compressed, offset))
            extra = extra[4 + n :]
        yield Member(name.decode("utf-8" if flags & UTF8 else "cp437"), method, crc, compressed, size, offset + shift)


def content(f: pa.NativeFile, m: Member) -> bytes:
    """The bytes of a member, checked against its sum."""
    f.seek(m.offset)
    head = f.read(30)
    if head[:4] != LOCAL or m.method not in (STORED, DEFLATED):
        raise zipfile.BadZipFile(f"{m.name} can't be read")
    f.seek(m.offset + 30 + sum(struct.unpack_from("<HH", head, 26)))
    data = f.read(m.compressed)
    data = zlib.decompress(data, -15) if m.method == DEFLATED else data
    if zlib.crc32(data) != m.crc:
        raise zipfile.BadZipFile(f"{m.name} is damaged")
    return data


@dataclass
class Runs(InputPartition):
    #: (archive, its length, first member, member after the last one or None)
    runs: list


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.glob, self.contents = options["path"], options.get("glob", "*.zip"), options.get("contents", "false").lower() == "true"
        self.most = int(options.get("taskbytes", R.TASK_BYTES))
        self.tests: dict[str, list] = {"zip": [], "member": []}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        return R.taken(filters, self.tests)

    def partitions(self) -> Sequence[InputPartition]:
        small, out = [], []
        for path, length in R.files_below(self.root, self.glob):
            if not R.passes(path, self.tests["zip"]):
                continue
            if length <= self.most:
                small.append(((path, length, 0, None), length))
                continue
            system, at = R.located(path)
            with system.open_input_file(at) as f:
                count = directory(f, length)[0]
            step = max(1, -(-count * self.most // length))
            out += [Runs([(path, length, i, i + step)]) for i in range(0, count, step)]
        return [*out, *(Runs(r) for r in R.packed(small, self.most))]

    def read(self, partition: Runs) -> Iterator[pa.RecordBatch]:
        held, rows = 0, []

        def batch() -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["zip", "member", "size", "compressed", "content"])

        for path, length, first, stop in partition.runs:
            system, at = R.located(path)
            with system.open_input_file(at) as f:
                for i, m in enumerate(members(f, length)):
                    if stop is not None and i >= stop:
                        break
                    if i >= first and R.passes(m.name, self.tests["member"]):
                        data = content(f, m) if self.contents else None
                        rows.append((path, m.name, m.size, m.compressed, data))
                        held += 200 + (len(data) if data else 0)
                        if held > 4 * R.CHUNK:
                            yield batch()
                            held, rows = 0, []
        if rows:
            yield batch()


class ArchiveMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> ArchiveReader:
        return ArchiveReader(self.options)


def archive_members(spark: SparkSession, root: str, glob: str = "*_trajectory.zip", contents: bool = False, task_bytes: int = R.TASK_BYTES) -> DataFrame:
    """zip, member, size, compressed, content (null unless asked for), stem (the number in a picture's name) of the archives below ``root``.

    ``root`` is on a file system that Arrow opens (local or shared folders, HDFS, object stores).  An archive that can't be read is an error.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveMembers)
    found = spark.read.format("archive_members").options(path=root, glob=glob, contents=str(contents).lower(), taskbytes=str(task_bytes)).load()
    return found.withColumn("stem", F.regexp_extract("member", r"(\d+)\.[A-Za-z]+$", 1).try_cast("int"))


def write_archives(df: DataFrame, folder: str) -> int:
    """Write ``df`` (zip, member, content) as archives in ``folder``, members by name; returns the number of members.

    Each archive is written by one task, member by member, under a name of its own and moved when it is whole, so a lost task leaves none in
    part.  Texts are UTF-8, nulls empty.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = R.located(folder)
        system.create_dir(top, recursive=True)
        task = TaskContext.get()
        temporary = f"{top}/.archive-{task.partitionId()}-{task.taskAttemptId()}"
        current, out, sink, n = None, None, None, 0

        def close() -> None:
            if current is not None:
                out.close()
                sink.close()
                system.move(temporary, f"{top}/{current}")

        for b in batches:
            for name, member, data in zip(*(b.column(c).to_pylist() for c in ("zip", "member", "content")), strict=True):
                if name != current:
                    close()
                    current, sink = name, system.open_output_stream(temporary)
                    out = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED)
                out.writestr(zipfile.ZipInfo(member, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
                n += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    rows = df.select("zip", "member", F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"))
    return rows.repartition("zip").sortWithinPartitions("zip", "member").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
