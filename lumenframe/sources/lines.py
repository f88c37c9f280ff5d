"""Lines of text files with their numbers, whatever the number of blocks that Spark reads a file in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe import schemas, storage


def _placed(spark: SparkSession, path: str, kept: Column) -> DataFrame:
    """A row for each line that ``kept`` (of ``value``) holds for, with its place in its block, and one without a line for each block, with the number of lines."""
    rows = spark.read.text(path).select(F.when(kept, F.col("value")).alias("value"), F.coalesce(kept, F.lit(False)).alias("kept"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task reads its blocks one after the other, each from its first line to its last.
        last, seen = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            file, block = b.column("file").dictionary_encode(), b.column("block").to_numpy()
            codes, keep = file.indices.to_numpy(), b.column("kept").to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero((np.diff(codes) != 0) | (np.diff(block) != 0)) + 1).tolist(), b.num_rows]
            out = []
            for s, e in zip(starts, starts[1:], strict=False):
                own = (file.dictionary[codes[s]].as_py(), int(block[s]))
                if own != last:
                    if last:
                        out.append((*last, seen, None, True))
                    last, seen = own, 0
                values = b.column("value").slice(s, e - s)
                out += [(*own, seen + i, values[i].as_py(), False) for i in np.flatnonzero(keep[s:e]).tolist()]
                seen += e - s
            yield table(out)
        if last:
            yield table([(*last, seen, None, True)])

    def table(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["file", "block", "place", "value", "whole"])

    return rows.mapInArrow(count, "file string, block long, place long, value string, whole boolean")


def numbered_lines(spark: SparkSession, path: str, kept: Column | None = None) -> DataFrame:
    """file, line (from 1), value of the lines below ``path`` for which ``kept`` holds (all but blank ones if not given); blank lines count.

    Lines are counted in each block as it is read; the counts of the blocks before it, of which there are as many as blocks, are added.
    """
    placed = storage.table(_placed(spark, path, F.trim("value") != "" if kept is None else kept), "lines")
    blocks = placed.filter("whole").select("file", "block", F.col("place").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select("file", "block", F.coalesce(before, F.lit(0)).alias("before"))
    return placed.filter("NOT whole").join(offsets, ["file", "block"]).select("file", (F.col("before") + F.col("place") + 1).alias("line"), "value")


def bad_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value of the lines that aren't JSON objects; blank lines are passed over."""
    bad = (F.trim("value") != "") & F.coalesce(~F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(True))
    return numbered_lines(spark, path, bad)


def read_jsonl_located(spark: SparkSession, path: str, schema: str = schemas.SAMPLE_DDL) -> DataFrame:
    """JSON lines with a schema; the first bad line is an error that names its file and line.

    The files are read once to look for bad lines, of which only the first comes to the driver.
    """
    first = bad_json_lines(spark, path).orderBy("file", "line").limit(1).collect()
    if first:
        raise ValueError(f"{first[0].file}:{first[0].line}: not a JSON object: {first[0].value[:200]}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
