"""Files read by ranges of bytes, on the file system that their URI names."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import EqualTo, Filter, StringContains, StringEndsWith, StringStartsWith

#: Bytes of files that a task takes, about, and that are fetched at a time where a file is read in order.
TASK_BYTES = 128 << 20
CHUNK = 1 << 20


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    plain = re.sub("^file:/*", "/", uri)
    return (fs.LocalFileSystem(), plain) if plain.startswith("/") else fs.FileSystem.from_uri(plain)


def files_below(root: str, glob: str) -> list[tuple[str, int]]:
    """Path (or URI) and size of the files below ``root`` whose name fits ``glob``, by path; ``root`` may be a file."""
    system, top = located(root)
    info = system.get_file_info(top)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(top, recursive=True))
    start = root[: len(root) - len(top)] if root.endswith(top) else ""
    return sorted((start + f.path, f.size) for f in found if f.is_file and fnmatch.fnmatchcase(f.base_name, glob))


def packed(sized: list[tuple[object, int]], most: int = TASK_BYTES) -> Iterator[list]:
    """Runs of things with about ``most`` bytes at most, or one larger thing."""
    run, held = [], 0
    for thing, size in sized:
        if run and held + size > most:
            yield run
            run, held = [], 0
        run.append(thing)
        held += size
    if run:
        yield run


# Tests of a text column that a source can make itself.
_TESTS = {EqualTo: str.__eq__, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__}


def taken(filters: list[Filter], columns: dict[str, list]) -> Iterator[Filter]:
    """Put tests of the given text columns into their lists, as (kind, value); the other filters are left to Spark."""
    for f in filters:
        own = columns.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
        if own is not None and type(f) in _TESTS and isinstance(f.value, str):
            own.append((type(f), f.value))
        else:
            yield f


def passes(value: str, tests: list) -> bool:
    return all(_TESTS[kind](value, wanted) for kind, wanted in tests)
