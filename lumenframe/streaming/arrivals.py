"""Arriving clips scored once each, with failed ones tried again by timer: a stateful processor over a key.

The state of a clip is a mark that it is done, or its waiting row and the number of tries.  So the work of a batch follows its own rows and the timers that are
due, not what has been scored before; state stays in RocksDB beside the checkpoint and can expire.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTING = "spark.sql.streaming.stateStore.providerClass"
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


class ScoreOnce(StatefulProcessor):
    """Scores the rows of a key until one is good; after that the key's rows are passed over.

    ``score`` takes a row as a dict and gives the new columns, or raises.  The last failed row waits for ``retry_ms``, at most ``tries`` times in all
    if that isn't 0; a later arrival of the key is tried at once.  ``kept_ms`` is how long a key is remembered after its last try (for good if None).
    """

    def __init__(self, score: Callable[[dict], dict], columns: list[str], given: list[str], retry_ms: int, tries: int, kept_ms: int | None) -> None:
        self.score, self.columns, self.given, self.retry_ms, self.tries, self.kept_ms = score, columns, given, retry_ms, tries, kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clip = handle.getValueState("clip", "done boolean, row string, tries int", self.kept_ms)

    def attempt(self, row: dict, tries: int, now: int) -> Iterator[pd.DataFrame]:
        """Score a row of a key that has failed ``tries`` times."""
        try:
            made = self.score(row)
        except Exception:  # whatever a scorer raises belongs to its clip, which waits
            again = not self.tries or tries + 1 < self.tries
            self.clip.update((False, json.dumps(row, default=str) if again else None, tries + 1))
            if again:
                self.handle.registerTimer(now + self.retry_ms)
            return
        self.clip.update((True, None, tries + 1))
        if tries:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        yield pd.DataFrame([{**{c: row.get(c) for c in self.columns}, **{c: made.get(c) for c in self.given}, "tries": tries + 1}])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        for frame in rows:
            for row in json.loads(frame.to_json(orient="records", date_format="iso", double_precision=15)):
                done, _, tries = self.clip.get() or (False, None, 0)
                if done:
                    return
                yield from self.attempt(row, tries, now)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done, row, tries = self.clip.get() or (True, None, 0)
        if not done and row:
            yield from self.attempt(json.loads(row), tries, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def scored_once(stream: DataFrame, key: str, score: Callable[[dict], dict], columns: str, retry_ms: int = 15_000, tries: int = 0, kept_ms: int | None = None) -> DataFrame:
    """The stream's rows with ``columns`` (a DDL) as ``score`` gives them and ``tries``, one row for each key that a row was good for.

    Rows go to ``score`` as JSON gives them: numbers, texts, booleans, lists and dicts, times as ISO texts.  Output columns of the stream keep numbers, texts and booleans
    (others should be cast to text before).  Rows without a key are one key.
    """
    given = T.StructType.fromDDL(columns)
    kept = stream.schema.fields
    schema = T.StructType([*kept, *given.fields, T.StructField("tries", T.IntegerType())])
    processor = ScoreOnce(score, [f.name for f in kept], given.names, retry_ms, tries, kept_ms)
    return stream.groupBy(key).transformWithStateInPandas(processor, outputStructType=schema, outputMode="append", timeMode="processingTime")


def reports_due(before: int, after: int, every: int) -> list[int]:
    """The multiples of ``every`` that a count has reached on its way from ``before`` to ``after``, all of them."""
    return list(range((before // every + 1) * every, after + 1, every))


def start_scoring(scored: DataFrame, out: str, checkpoint: str, every: int = 0, poll: str | None = None) -> StreamingQuery:
    """Write the rows of ``scored_once`` to ``out``, a folder for each batch, with the count so far and the reports that are due.

    A batch writes ``batch=N`` in ``out/scores``, the number scored up to then in ``out/totals`` and, with ``every``, a row (processed) for each multiple of it that
    has been reached in ``out/reports``.  It reads the total of the batch before it and nothing else, and a repeated batch overwrites its own folders.  Without ``poll`` the query ends
    when all files are read; clips that wait then are tried with the next rows after it is started again on the same checkpoint.
    """
    spark = scored.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        before = spark.read.schema("processed long").parquet(f"{out}/totals/batch={number - 1}").first()[0] if number else 0
        target = f"{out}/scores/batch={number}"
        batch.write.mode("overwrite").parquet(target)
        after = before + spark.read.schema(batch.schema).parquet(target).count()
        due = reports_due(before, after, every) if every else []
        total = lambda values: spark.createDataFrame([(v,) for v in values], "processed long").coalesce(1)
        if every:
            total(due).write.mode("overwrite").parquet(f"{out}/reports/batch={number}")
        total([after]).write.mode("overwrite").parquet(f"{out}/totals/batch={number}")

    # A query keeps the settings that it starts with.  Batches without new rows serve timers; a query that ends with its files has none.
    settings = {SETTING: PROVIDER, NO_DATA: str(poll is not None).lower()}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        writer = scored.writeStream.foreachBatch(take).outputMode("append").option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def scores(spark: object, out: str, schema: T.StructType) -> DataFrame:
    """What has been written so far; no rows where no batch has been."""
    return spark.read.schema(schema).option("basePath", f"{out}/scores").option("pathGlobFilter", "*.parquet").parquet(f"{out}/scores").select(*[F.col(f"`{n}`") for n in schema.names])
