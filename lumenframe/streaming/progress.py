"""Rolling summaries over clips that arrive as files, and an append-only metric log; see ``arrivals`` for scoring them once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def clip_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def once_per_key(stream: DataFrame, key: str, ok: str | None = None, time: str | None = None, horizon: str | None = None) -> DataFrame:
    """The first good row of each key; rows that failed aren't remembered, so a later one of the key counts.

    Keys are remembered for good, so the state grows with their number.  With ``time`` and ``horizon`` a key is forgotten
    when event time is past it by the horizon, and the state is bounded by the keys of that span.
    """
    good = stream.filter(F.coalesce(F.col(ok), F.lit(False))) if ok else stream
    if time and horizon:
        return good.withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])
    return good.dropDuplicates([key])


def each_alone(rows: DataFrame, score: Callable[[dict], dict], columns: str) -> DataFrame:
    """``rows`` with ``columns`` (a DDL) as ``score`` gives them for each row, and ``ok`` and ``error``.

    A row that ``score`` fails on has nulls, ``ok`` false and the error's text, and the others go on.
    """
    names = [f.name for f in T.StructType.fromDDL(columns).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                try:
                    given = score(row)
                    out.append([*(given.get(n) for n in names), True, None])
                except Exception as e:  # whatever a scorer raises belongs to its row
                    out.append([*(None for _ in names), False, f"{type(e).__name__}: {e}"])
            yield b.assign(**{n: [o[i] for o in out] for i, n in enumerate([*names, "ok", "error"])})

    given = T.StructType.fromDDL(f"{columns}, ok boolean, error string")
    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, *given.fields]))


def rolling(stream: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Count and means so far, rewritten as a whole on each batch."""
    return stream.groupBy(*by).agg(F.count("*").alias("processed"), *[F.avg(m).alias(m) for m in metrics])


def to_table(frame: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all files that are there and return its result as a table in memory (a summary)."""
    q = frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return frame.sparkSession.table(name)


def append_log(frame: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the rows of a stream (time, step, payload) as JSON lines; rows with an empty payload go."""
    kept = frame.filter(F.coalesce("payload", F.lit("")).isin("", "{}") == F.lit(False))
    return kept.writeStream.outputMode("append").format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(stream: DataFrame, time: str, every: str, late: str, by: str, value: str) -> DataFrame:
    """Count and sum in tumbling windows of event time, with a bound on lateness."""
    return stream.withWatermark(time, late).groupBy(F.window(time, every), by).agg(F.count("*").alias("n"), F.sum(value).alias("v"))
