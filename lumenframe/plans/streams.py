"""Streaming queries; each runs over the files that are there and gives the final state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumenframe import storage
from lumenframe.plans.registry import query, read
from lumenframe.streaming import arrivals as A
from lumenframe.streaming import progress as S


def _stream(spark, sf_dir, name):
    """The table's folder or file as a stream of Parquet files."""
    table = read(spark, sf_dir, name)
    return spark.readStream.schema(table.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


@query("SELECT event_type, count(*) AS processed, round(avg(value), 6) AS value FROM (SELECT DISTINCT event_id, event_type, value FROM events) GROUP BY 1")
def stream_progress(spark, sf_dir):
    """Counts and means so far over clips that are each taken once."""
    rows = S.once_per_key(_stream(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_id")
    return S.to_table(S.rolling(rows, ["event_type"], ["value"]), f"progress_{uuid.uuid4().hex}").withColumn("value", F.round("value", 6))


@query("SELECT event_type, count(*) AS processed FROM events WHERE value >= 1 GROUP BY 1")
def stream_good_rows(spark, sf_dir):
    """Failed rows (small values) aren't remembered."""
    rows = S.once_per_key(_stream(spark, sf_dir, "events").withColumn("ok", F.col("value") >= 1), "event_id", "ok")
    return S.to_table(S.rolling(rows, ["event_type"], []), f"good_{uuid.uuid4().hex}")


@query("""SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2""")
def stream_windows(spark, sf_dir):
    """Tumbling days of event time (an extension: the reference has no event time)."""
    rows = S.tumbling(_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "1 day", "event_type", "value")
    out = S.to_table(rows, f"days_{uuid.uuid4().hex}")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("v", 4).alias("v"))


def _of_user(row):
    """A score of the clip (the user); rows of small values fail."""
    if row["value"] < 1:
        raise ValueError("too small")
    return {"score": row["user_id"] * 2.0}


@query("""WITH s AS (SELECT user_id, user_id * 2.0::DOUBLE AS score FROM events WHERE value >= 1 GROUP BY ALL), n AS (SELECT count(*) AS n FROM s)
SELECT 'clips' AS what, count(*) AS rows, round(sum(score), 4) AS total FROM s UNION ALL SELECT 'reports', n // 10, ((n // 10) * (n // 10 + 1) * 5)::DOUBLE FROM n""")
def scored_arrivals(spark, sf_dir):
    """Every event is an arrival of its user's clip; those of small values fail, and the first good one scores the clip once.  Reports come at every ten clips."""
    out, state = storage.new_path(spark, "scores"), storage.new_path(spark, "scores-state")
    scored = A.scored_once(_stream(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", _of_user, "score double")
    A.start_scoring(scored, out, state, every=10).awaitTermination()
    done = A.scores(spark, out, scored.schema).agg(F.lit("clips").alias("what"), F.count("*").alias("rows"), F.round(F.sum("score"), 4).alias("total"))
    reports = spark.read.schema("processed long").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{out}/reports")
    return done.unionByName(reports.agg(F.lit("reports").alias("what"), F.count("*").alias("rows"), F.coalesce(F.sum("processed"), F.lit(0)).cast("double").alias("total")))
