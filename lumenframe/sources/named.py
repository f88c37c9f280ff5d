"""One named file for each value of a column: a sink whose files appear when the whole write has succeeded.

``df.write.format("named_files")`` takes rows (file, line).  Each task writes under a folder of the write's own; the commit moves the files to their names and the abort
removes that folder, so a failed task or write leaves nothing behind.  Files of any size pass through one task line by line.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from lumenframe.sources import ranges as R


@dataclass
class Written(WriterCommitMessage):
    #: (name, temporary path, number of lines) of each file that the task has written
    files: list


class NamedWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.own = options["path"].rstrip("/"), f".write-{uuid.uuid4().hex}"

    def at(self) -> tuple[fs.FileSystem, str]:
        system, top = R.located(self.folder)
        return system, top.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Written:
        system, top = self.at()
        task, files, out, last = TaskContext.get(), [], None, None
        place = f"{top}/{self.own}/{task.partitionId()}-{task.taskAttemptId()}"
        try:
            for row in iterator:
                if row.file != last:
                    if out:
                        out.close()
                    if not row.file or "/" in row.file or any(row.file == f[0] for f in files):
                        raise ValueError(f"no name for a file, or one that comes again: {row.file}")
                    system.create_dir(place, recursive=True)
                    last, out = row.file, system.open_output_stream(f"{place}/{row.file}")
                    files.append([last, f"{place}/{last}", 0])
                out.write(f"{row.line}\n".encode())
                files[-1][2] += 1
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, top = self.at()
        files = [f for m in messages if m for f in m.files]
        names = [f[0] for f in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two tasks have written one file; repartition by its name")
        system.create_dir(top, recursive=True)
        for name, temporary, _ in files:
            system.move(temporary, f"{top}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, top = self.at()
        if system.get_file_info(f"{top}/{self.own}").type != fs.FileType.NotFound:
            system.delete_dir(f"{top}/{self.own}")


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "file string, line string"

    def writer(self, schema: object, overwrite: bool) -> NamedWriter:
        return NamedWriter(self.options)


def write_named(df: DataFrame, folder: str, order: list[str] | None = None) -> None:
    """Write ``df`` (file, line) to ``folder``, a file for each name, lines in the order of the columns ``order``; files of that name are replaced.

    A line is text without its end; null lines are empty.  ``folder`` is on a file system that Arrow opens.
    """
    df.sparkSession.dataSource.register(NamedFiles)
    rows = df.repartition("file").sortWithinPartitions("file", *(order or [])).select("file", F.coalesce(F.col("line").cast("string"), F.lit("")).alias("line"))
    rows.write.format("named_files").mode("append").option("path", folder).save()


def write_text(text: str, path: str, spark: SparkSession | None = None) -> None:
    """A small document under its name, written by the driver; readers see the old one or the whole new one."""
    system, at = R.located(path)
    folder, _, name = at.rpartition("/")
    temporary = f"{folder}/.{name}-{uuid.uuid4().hex}"
    system.create_dir(folder, recursive=True)
    with system.open_output_stream(temporary) as out:
        out.write(text.encode())
    system.move(temporary, at)


def document(value: object) -> str:
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n"
