"""The session that queries expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "lumenframe", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with ANSI SQL, UTC and adaptive execution; a cluster's own settings win where they are given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true")
            .config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").getOrCreate())
