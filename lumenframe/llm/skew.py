"""Joins of many rows to one row a key, where a few keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than 1/HOT_SHARE of the rows is hot; so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1024
LEAST_HOT = 1000
SALTS = 64


def hot_keys(keyed: DataFrame, key: str, weight: str) -> DataFrame:
    """``_hot``: the keys of ``keyed`` (one row a key) whose ``weight`` is more than 1/HOT_SHARE of all; fewer than HOT_SHARE rows."""
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    return keyed.filter(F.col(weight) > max(total / HOT_SHARE, LEAST_HOT)).select(F.col(key).alias("_hot"))


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, weight: str, spread: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """Join of ``rows`` to ``keyed`` on ``key``, ``inner`` or ``left``; hot keys are joined under SALTS salts.

    ``keyed`` has one row a key and should be a stored table, as it is read three times; ``weight`` there is
    the number of rows of the key, and ``spread`` a column of ``rows`` that tells a key's rows apart.  Null
    keys find nothing.  ``hot`` (see ``hot_keys``) may be given where ``keyed`` hasn't all keys of ``rows``.  The list of hot keys
    is broadcast: it has fewer than HOT_SHARE rows whatever the input.
    """
    hot = F.broadcast(hot_keys(keyed, key, weight) if hot is None else hot)
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0).cast("int")
    every = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot")
    right = keyed.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")
