"""Exact deduplication over an extendible-hash index kept on shared files (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lumenframe.llm import scratch
from lumenframe.llm.skew import HOT_SHARE, LEAST_HOT

#: Characters that equality ignores: space and the five ASCII controls from tab to carriage return.
IGNORED = " \t\n\x0b\x0c\r"
#: The directory has 2**TOP slots, so that it can be broadcast; buckets below a slot are told apart by further bits of the key.
TOP = 12
#: Entries (distinct keys) that a bucket holds at least and at most before it is split.
SMALLEST, LARGEST = 64, 250_000
#: Characters of text for each reducer at most, about, and key ranges for each reducer.
TASK_CHARS, OWNERS = 32 << 20, 8
SALTS = 64


def normalised(text: Column) -> Column:
    """The text without the ignored characters; null counts as empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in IGNORED:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def slot_of(key: Column) -> Column:
    """The first TOP bits of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - TOP).cast("int")


def below(depth: str = "depth") -> str:
    """SQL for the bits of a key between its slot's and its bucket's last one, as a number; 0 where the bucket is no deeper than the slot."""
    return f"CASE WHEN {depth} > {TOP} THEN shiftrightunsigned(shiftleft(key, {TOP}), 64 - ({depth} - {TOP})) ELSE 0L END"


def deepened(keys: DataFrame, counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Depth of the buckets of each overfull slot (slot to number of keys), doubled bit by bit until none of its buckets is overfull.

    Keys are distinct, so this ends; only a number for each slot comes to the driver.
    """
    spark, done, left = keys.sparkSession, {}, {s: TOP + max(1, -(-n // capacity) - 1).bit_length() for s, n in counts.items()}
    while left:
        depths = F.broadcast(spark.createDataFrame(list(left.items()), "slot int, depth int"))  # at most 2**TOP rows
        held = keys.withColumn("slot", slot_of(F.col("key"))).join(depths, "slot").groupBy("slot", "depth", F.expr(below()).alias("sub")).agg(F.count("*").alias("n"))
        fullest = {r.slot: r.n for r in held.groupBy("slot").agg(F.max("n").alias("n")).collect()}
        done |= {s: d for s, d in left.items() if fullest[s] <= capacity or d == 64}
        left = {s: d + 1 for s, d in left.items() if s not in done}
    return done


def directory(keys: DataFrame, owners: int, capacity: int | None = None) -> DataFrame:
    """The directory of the index, a row for each of the 2**TOP slots: slot, depth (of its buckets), owner, owners.

    ``keys`` has the distinct 64-bit ``key``s.  The directory doubles as long as a bucket is overfull: a slot belongs to the bucket
    of the least depth at which all keys with its prefix fit ``capacity``; slots that are overfull by themselves have deeper buckets.
    Owners take consecutive buckets with about the same number of keys; an overfull slot's buckets are dealt to ``owners``
    owners from ``owner`` on.  Counts of the slots, at most 2**TOP, come to the driver.
    """
    counts = {r.slot: r.n for r in keys.groupBy(slot_of(F.col("key")).alias("slot")).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if capacity is None:
        capacity = min(max(total // owners, SMALLEST), LARGEST)
    levels = [[counts.get(s, 0) for s in range(1 << TOP)]]
    while len(levels[0]) > 1:
        levels.insert(0, [a + b for a, b in zip(levels[0][::2], levels[0][1::2], strict=True)])
    deep = deepened(keys, {s: n for s, n in counts.items() if n > capacity}, capacity)
    rows, slot, before = [], 0, 0
    while slot < 1 << TOP:
        depth = deep.get(slot) or next(d for d in range(TOP + 1) if not slot % (1 << TOP - d) and levels[d][slot >> TOP - d] <= capacity)
        width, held = (1 << TOP - depth, levels[depth][slot >> TOP - depth]) if depth <= TOP else (1, counts[slot])
        first = before * owners // max(total, 1)
        share = max(1, min((before + held) * owners // max(total, 1), owners) - first) if depth > TOP else 1
        rows += [(s, depth, first, share) for s in range(slot, slot + width)]
        slot, before = slot + width, before + held
    return keys.sparkSession.createDataFrame(rows, "slot int, depth int, owner int, owners int")


def routed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (with ``key``) with the ``bucket`` (its least key) and the ``owner`` that the directory ``found`` names."""
    placed = rows.withColumn("slot", slot_of(F.col("key"))).join(F.broadcast(found), "slot")  # 2**TOP rows
    bucket = F.expr("CASE WHEN depth > 0 THEN shiftleft(shiftrightunsigned(key, 64 - depth), 64 - depth) ELSE 0L END")
    owner = F.col("owner") + F.expr(f"CASE WHEN owners > 1 THEN floor({below()} * owners / shiftleft(1L, depth - {TOP})) ELSE 0 END")
    return placed.withColumns({"bucket": bucket, "owner": owner.cast("int")}).drop("slot", "depth", "owners")


def build_index(texts: DataFrame, digests: DataFrame, found: DataFrame, parts: int) -> DataFrame:
    """Index of the distinct texts: owner, bucket, key, chain, sha, keep_id, keep_chars, keep_uid, group_size.

    ``texts`` (key, norm, n, id) are dealt to the owners of their buckets, which compare texts of equal key by their bytes: texts that
    differ are chained, equal ones are one entry.  Keys with more than 1/HOT_SHARE of all rows (fewer than HOT_SHARE of them) are
    first merged under SALTS salts, so no owner gets all their rows.  ``digests`` (uid, id, n, key, sha) tell fully equal rows apart.
    """
    most = max(digests.count() / HOT_SHARE, LEAST_HOT)
    hot = digests.groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > most).select("key", F.lit(True).alias("hot"))
    placed = routed(texts.join(F.broadcast(hot), "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False))), found)
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id", "n", F.monotonically_increasing_id()), F.lit(SALTS))).otherwise(0).cast("int")
    dealt = placed.withColumn("salt", salt).repartition(parts, "owner", "salt")
    keep = F.min(F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("none"), "id")).alias("keep")
    merged = dealt.groupBy("owner", "salt", "bucket", "key", "hot", "norm").agg(F.count("*").alias("group_size"), keep)
    some = scratch.table(merged.withColumn("sha", F.unhex(F.sha2("norm", 256))).withColumn("norm", F.when(F.col("hot"), F.col("norm"))).drop("salt"), "exact-merged")
    again = some.filter("hot").groupBy("owner", "bucket", "key", "norm").agg(F.first("sha").alias("sha"), F.sum("group_size").alias("group_size"), F.min("keep").alias("keep"))
    entries = some.filter("NOT hot").drop("hot", "norm").unionByName(again.drop("norm"))
    # Of rows alike in id and text one is kept: the one with the least number.
    first = F.min(F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("none"), "id", "uid")).alias("f")
    entries = entries.join(digests.groupBy("key", "sha").agg(first).select("key", "sha", F.col("f.uid").alias("keep_uid")), ["key", "sha"])
    chain = F.row_number().over(Window.partitionBy("owner", "bucket", "key").orderBy("sha")) - 1
    return scratch.table(entries.withColumn("chain", chain).select(
        "owner", "bucket", "key", "chain", "sha", F.col("keep.id").alias("keep_id"), (-F.col("keep.n")).alias("keep_chars"), "keep_uid", "group_size"), "exact-index")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None) -> DataFrame:
    """One row for each row of ``df``: doc_id, keep_id, group_size, kept, text_sha256, chain.

    Of the rows with equal normalised text the one with the most code points in its own text stays,
    then the one with the smallest id (a null id comes last).  Null texts count as empty, and all
    empty texts are one group.  Where rows repeat both id and text, exactly one has ``kept``.
    An empty table gives an empty result.  Other columns of ``df`` are not read.

    Keys and digests are made once and stored.  Texts move once, to the owners of their buckets; then the digests probe the index: the
    directory names a row's bucket, and its entry there has its key and digest.
    """
    rows = df.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"),
                     F.char_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long").alias("n"))
    rows = rows.withColumn("key", F.xxhash64("norm"))
    digests = scratch.table(rows.select(F.monotonically_increasing_id().alias("uid"), "id", "n", "key", F.unhex(F.sha2("norm", 256)).alias("sha")), "exact-digests")
    parts = max(scratch.partitions(df.sparkSession), math.ceil((digests.agg(F.sum("n")).first()[0] or 0) / TASK_CHARS))
    found = directory(digests.select("key").distinct(), OWNERS * parts, capacity)
    index = build_index(rows, digests, found, parts)
    # Hot groups: fewer than HOT_SHARE by definition, so their list may be broadcast.
    most = max(digests.count() / HOT_SHARE, LEAST_HOT)
    hot = F.broadcast(index.filter(F.col("group_size") > most).select("key", "sha", F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("uid"), F.lit(SALTS))).otherwise(0).cast("int")
    probe = routed(digests, found).join(hot, ["key", "sha"], "left").withColumn("salt", salt).drop("hot", "owner")
    every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    held = index.drop("owner").join(hot, ["key", "sha"], "left").withColumn("salt", F.explode(every)).drop("hot")
    met = probe.join(held, ["bucket", "key", "sha", "salt"])
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_chars")) & (F.col("uid") == F.col("keep_uid"))
    return met.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "chain")


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that ``exact_dedup`` keeps, with all columns of ``df`` as they are.

    Nulls, empty texts and ties count as there; of rows alike in id and text the one with the most code points stays, and an
    empty table stays empty.  Equal rows are merged before the shuffle.
    """
    key = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))  # noqa: E731  null ids are a key too
    marks = exact_dedup(df, id_col, text_col).filter("kept").select(key(F.col(id_col)).alias("key"), "text_sha256")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), key(F.col(id_col)).alias("key"),
                     F.char_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("n"), F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"))
    one = rows.groupBy("key", "text_sha256").agg(F.max_by("row", "n").alias("row"))
    return one.join(marks, ["key", "text_sha256"], "left_semi").select("row.*")
