"""URL filters with dated lists (DataFrame functions only).

A list is a stream of dated entries (key, action, since).  Entries of a key become validity intervals,
and an as-of join tests every capture against the entries that are active when it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lumenframe.llm import scratch
from lumenframe.llm.skew import HOT_SHARE, LEAST_HOT, hot_keys, join_hot


def host_of(url: Column) -> Column:
    """Lower-case host without user, port or last dot; null where there is none."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(rest, r"^.*@", ""), r":\d*$", "")
    host = F.regexp_replace(F.lower(host), r"\.$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """The path without query and fragment, from its first slash on."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys_of(host: Column, path: Column) -> Column:
    """What a list entry may name: the host and its parent domains, and the host with each leading part of the path."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    n = F.size(parts)
    prefixes = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"))))
    return F.array_distinct(F.concat(domains, F.coalesce(prefixes, F.array().cast("array<string>"))))


def changes(entries: DataFrame) -> DataFrame:
    """Days on which a key's state changes, from ``entries`` (key, action, since): key, since, on.

    An ``add`` holds from its date until the key's next entry that isn't an ``add``; equal dates count as one entry, where
    an ``add`` wins.  So the validity intervals of a key run from each ``on`` to the row after it.  Hosts count in lower case,
    paths as they are.  Rows with a null key, an unknown action, or a date that is null or can't be read, don't count.
    A key has at most one row a day, however many entries it has.
    """
    since = F.col("since").try_cast("date")
    known = entries.filter(F.col("key").isNotNull() & since.isNotNull() & F.col("action").isin("add", "remove"))
    host = F.regexp_extract("key", r"^([^/]*)", 1)
    key = F.concat(F.lower(host), F.regexp_extract("key", r"(?s)^[^/]*(.*)$", 1))
    one = known.groupBy(key.alias("key"), since.alias("since")).agg(F.max(F.col("action") == "add").alias("on"))
    was = F.coalesce(F.lag("on").over(Window.partitionBy("key").orderBy("since")), F.lit(False))
    return one.withColumn("was", was).filter(F.col("on") != F.col("was")).drop("was")


def url_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", fetched_col: str = "fetched") -> DataFrame:
    """Every capture with what the list says of it at its fetch time.

    Returns the id, host, fetched (date), blocked, n_active (active entries that name the URL), matched_key
    (the longest of them, of equally long ones the greatest) and listed_since (its date).  An entry names a URL
    by its host, a parent domain, or the host with a leading part of the path.  A URL without a host, a null URL, and
    a date that is null or can't be read (fetched is null then) are not blocked.  Rows that repeat an id are rows of their own;
    empty tables give no row, or no match.  Only ids, URLs and dates are read.

    The as-of join lays captures and changes of a key in one order of days, and each capture takes the last change before or on
    its day.  Nothing depends on how far days lie apart.  Keys with more than 1/HOT_SHARE of all lookups are split into so many
    parts that none is larger; their changes (one a day at most) go to each part.
    """
    plain = captures.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(fetched_col).try_cast("date").alias("fetched"))
    held = scratch.table(plain.withColumn("uid", F.monotonically_increasing_id()), "captures")
    listed = scratch.table(changes(entries), "list-changes")
    asked = held.filter(F.col("host").isNotNull() & F.col("fetched").isNotNull()).select("uid", F.col("fetched").alias("day"), F.explode(keys_of(F.col("host"), F.col("path"))).alias("key"))
    uses = scratch.table(asked.groupBy("key").agg(F.count("*").alias("n")), "list-uses")
    named = uses.join(listed.select("key").distinct(), "key", "left_semi")
    most = max((uses.agg(F.sum("n")).first()[0] or 0) / HOT_SHARE, LEAST_HOT)
    parts = F.ceil(F.col("n") / most).cast("int")
    left = join_hot(asked, named, "key", "n", "uid", hot=hot_keys(uses, "key", "n")).select(
        "key", F.pmod(F.xxhash64("uid"), parts).cast("int").alias("part"), "day", F.lit(1).alias("is_capture"), "uid", F.lit(None).cast("struct<on:boolean,since:date>").alias("change"))
    right = listed.join(named, "key").select(
        "key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("since").alias("day"), F.lit(0).alias("is_capture"), F.lit(None).cast("long").alias("uid"), F.struct("on", "since").alias("change"))
    order = Window.partitionBy("key", "part").orderBy("day", "is_capture").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = left.unionByName(right).withColumn("last", F.last("change", True).over(order)).filter("is_capture = 1 AND last.on")
    of_row = met.groupBy("uid").agg(F.count("*").alias("n_active"), F.max(F.struct(F.length("key").alias("n"), "key", F.col("last.since").alias("since"))).alias("m"))
    out = held.join(of_row, "uid", "left")
    return out.select(F.col("id").alias(id_col), "host", "fetched", F.col("n_active").isNotNull().alias("blocked"), F.coalesce("n_active", F.lit(0)).alias("n_active"),
                      F.col("m.key").alias("matched_key"), F.col("m.since").alias("listed_since"))
