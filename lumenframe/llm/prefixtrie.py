"""The prefix trie of conversations, found by blocks of turns of fixed length.

A prefix of d turns is named by 128 bits: the exclusive or, over its turns, of two hashes of turn and place.  So prefixes of any length can be
named in parallel: blocks of BLOCK turns first, then running values over the blocks of a conversation (over groups of GROUP blocks where it is
very long).  Conversations are grouped by the names of their block ends.  Where all that reach the start of a block go on through the same whole
block, its turns have the same members and stay one unit; only where siblings diverge, or a conversation ends, the block is
cut at its turns.

Subtree sums need no walk: each node belongs to its smallest member, and a conversation owns the nodes from one depth on.  What the subtree of
a node saves is the sum, over its members but the smallest, of the lengths of their turns from the node on to where their own nodes begin; so it and
the number of leaves are sums over members, one grouping of units by name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm import scratch
from lumenframe.llm.simhash import with_last
from lumenframe.llm.skew import hot_keys, join_hot

#: Turns of a block, and blocks of a long conversation that are put together at a time.
BLOCK = 4
GROUP = 1024
#: Rows of each range task, about.
TASK_ROWS = 1 << 20
#: Turns that a conversation takes over from another one at most.
LENT = 5
EMPTY = hashlib.sha256(b"").hexdigest()
TURN = "struct<x:bigint,y:bigint,len:bigint>"


def ranked(turns: DataFrame) -> DataFrame:
    """``c``, ``r`` (place among the turns of c, from 0), ``dig``, ``len`` of each of the stored ``turns`` (c, turn, dig, len).

    Rows are sorted in ranges, so a long conversation lies in several tasks; each counts its own rows, and at most one conversation of a
    range began before it.
    """
    spark = turns.sparkSession
    parts = max(scratch.partitions(spark), math.ceil(turns.count() / TASK_ROWS))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            c = b.column("c").to_numpy()
            if not len(c):
                continue
            starts = np.concatenate([[0], np.flatnonzero(np.diff(c)) + 1])
            place = np.arange(len(c)) - np.repeat(starts, np.diff([*starts, len(c)]))
            if c[0] == last:
                place[: starts[1] if len(starts) > 1 else len(c)] += seen
            last, seen = c[-1], place[-1] + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), pid, np.int32)), b.column("c"), pa.array(place), b.column("dig"), b.column("len")], ["pid", "c", "r", "dig", "len"])

    key = [F.asc("c"), F.asc_nulls_first("turn"), F.asc("dig")]
    sorted_ = turns.repartitionByRange(parts, *key).sortWithinPartitions(*key)
    rows = scratch.table(sorted_.mapInArrow(number, "pid int, c long, r long, dig binary, len long"), "trie-ranked")
    pieces = rows.groupBy("pid", "c").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("c").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    later = pieces.select(F.col("pid").alias("_pid"), F.col("c").alias("_c"), before.alias("before")).filter("before > 0")  # a row a range at most
    placed = rows.join(F.broadcast(later), (F.col("pid") == F.col("_pid")) & (F.col("c") == F.col("_c")), "left")
    return placed.select("c", (F.col("r") + F.coalesce("before", F.lit(0))).alias("r"), "dig", "len")


def blocks_of(rebuilt: DataFrame) -> DataFrame:
    """A row for each block of each conversation of ``rebuilt`` (c, L, pos, dig, len): c, L, k, start and end (names), cum, turns."""
    named = rebuilt.select("c", "L", "pos", F.xxhash64(F.lit(1), "dig", "pos").alias("x"), F.xxhash64(F.lit(2), "dig", "pos").alias("y"), "len")
    turns = F.transform(F.sort_array(F.collect_list(F.struct("pos", "x", "y", "len"))), lambda t: F.struct(t["x"].alias("x"), t["y"].alias("y"), t["len"].alias("len")))
    sums = [F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"), F.sum("len").alias("bl")]
    own = named.groupBy("c", "L", F.expr(f"pos div {BLOCK}").alias("k")).agg(turns.alias("turns"), *sums)
    own = own.withColumn("g", F.expr(f"k div {GROUP}"))
    inside = Window.partitionBy("c", "g").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    over = lambda w: [f(c).over(w).alias(a) for f, c, a in ((F.bit_xor, "bx", "px"), (F.bit_xor, "by", "py"), (F.sum, "bl", "pl"))]
    local = scratch.table(own.select("*", *over(inside)), "trie-blocks")
    groups = local.groupBy("c", "g").agg(*[f(c).alias(c) for f, c in ((F.bit_xor, "bx"), (F.bit_xor, "by"), (F.sum, "bl"))])
    whole = groups.select("c", "g", *over(Window.partitionBy("c").orderBy("g").rowsBetween(Window.unboundedPreceding, -1))).filter("g > 0")
    whole = whole.select("c", "g", *[F.col(p).alias(f"g{p}") for p in ("px", "py", "pl")])
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    late = local.filter("g > 0").join(whole, ["c", "g"])
    both = late.unionByName(local.filter("g = 0"), allowMissingColumns=True)
    start = [zero(p).bitwiseXOR(zero(f"g{p}")) for p in ("px", "py")]
    return both.select("c", "L", "k", named_(*start).alias("start"), named_(start[0].bitwiseXOR(F.col("bx")), start[1].bitwiseXOR(F.col("by"))).alias("end"),
                       (zero("pl") + zero("gpl")).alias("cum"), "turns")


def named_(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def units_of(blocks: DataFrame, n_convs: Column, spark_row: DataFrame) -> DataFrame:
    """Units of consecutive turns with the same members: c, L, node and parent (names), depth (of the first turn), cum (before it), lens.

    A block stays one unit where all members of its start have it; others are cut at their turns.
    """
    groups = scratch.table(blocks.groupBy("start", "end").agg(F.count("*").alias("n")), "trie-ends")
    root = spark_row.select(named_(F.lit(0).cast("long"), F.lit(0).cast("long")).alias("name"), n_convs.alias("own"), F.lit(0).cast("long").alias("child"), F.lit(0).cast("long").alias("rows"))
    own = groups.select(F.col("end").alias("name"), F.col("n").alias("own"), F.lit(0).cast("long").alias("child"), F.lit(0).cast("long").alias("rows"))
    child = groups.select(F.col("start").alias("name"), F.lit(0).cast("long").alias("own"), F.col("n").alias("child"), F.col("n").alias("rows"))
    # Ends that are the same prefix with other starts can't be: a block's start follows from its end.
    names = own.unionByName(root).unionByName(child).groupBy("name").agg(F.max("own").alias("own"), F.max("child").alias("child"), F.sum("rows").alias("rows"))
    names = scratch.table(names.filter("child > 0").select(F.col("name").alias("start"), (F.col("own") == F.col("child")).alias("straight"), "rows"), "trie-names")
    told = join_hot(blocks, names, "start", "rows", "c").drop("rows")
    size = F.size("turns")
    upto = lambda i, x: F.aggregate(F.slice("turns", 1, i + 1), F.col(f"start.{x}"), lambda a, t: a.bitwiseXOR(t[x]))
    first = F.col("k") * BLOCK + 1
    lens = F.transform("turns", lambda t: t["len"])
    one = F.array(F.struct(F.col("end").alias("node"), F.col("start").alias("parent"), first.alias("depth"), F.col("cum").alias("cum"), lens.alias("lens")))
    cut = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(
        named_(upto(i, "x"), upto(i, "y")).alias("node"), named_(upto(i - 1, "x"), upto(i - 1, "y")).alias("parent"), (first + i).alias("depth"),
        F.aggregate(F.slice("turns", 1, i), F.col("cum"), lambda a, t: a + t["len"]).alias("cum"), F.slice(lens, i + 1, 1).alias("lens")))
    return told.select("c", "L", F.explode(F.when(F.col("straight"), one).otherwise(cut)).alias("u")).select("c", "L", "u.*")


def ends_digests(ends: DataFrame) -> DataFrame:
    """``node``, ``ends_sha256`` of the stored ``ends`` (node, c): the ids in order, joined by commas.

    Nodes with one id are hashed in place.  Others are sorted in ranges, where each task joins the ids of a node to one piece of text; then the
    pieces of a node pass through the hash one after the other, which is all that a task holds.
    """
    spark = ends.sparkSession
    counts = scratch.table(ends.groupBy("node").agg(F.count("*").alias("n"), F.min("c").alias("c")), "trie-end-counts")
    alone = counts.filter("n = 1").select("node", F.sha2(F.col("c").cast("string"), 256).alias("ends_sha256"))
    many = scratch.table(counts.filter("n > 1").select("node", "n"), "trie-many-ends")
    total = many.agg(F.sum("n")).first()[0] or 0
    rows = join_hot(ends, many, "node", "n", "c", hot=hot_keys(many, "node", "n")).select(F.col("node.x").alias("x"), F.col("node.y").alias("y"), "c")
    parts = max(scratch.partitions(spark), math.ceil(total / TASK_ROWS))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, c = (b.column(n).to_numpy() for n in ("x", "y", "c"))
            if len(c):
                starts = np.concatenate([[0], np.flatnonzero((np.diff(x) != 0) | (np.diff(y) != 0)) + 1])
                text = [",".join(map(str, c[s:e].tolist())) for s, e in zip(starts, [*starts[1:], len(c)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x[starts]), pa.array(y[starts]), pa.array(c[starts]), pa.array(text)], ["x", "y", "c", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, hashed, out = None, None, []
        for last, b in with_last(batches):
            for x, y, ids in zip(*(b.column(n).to_pylist() for n in ("x", "y", "ids")), strict=True):
                if node == (x, y):
                    hashed.update(b"," + ids.encode())
                    continue
                if node:
                    out.append((*node, hashed.hexdigest()))
                node, hashed = (x, y), hashlib.sha256(ids.encode())
            if last and node:
                out.append((*node, hashed.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["x", "y", "ends_sha256"])
            out = []

    chunks = scratch.table(rows.repartitionByRange(parts, "x", "y", "c").sortWithinPartitions("x", "y", "c").mapInArrow(pieces, "x long, y long, c long, ids string"), "trie-end-pieces")
    hashed = chunks.repartition(parts, "x", "y").sortWithinPartitions("x", "y", "c").mapInArrow(digest, "x long, y long, ends_sha256 string")
    return alone.unionByName(hashed.select(named_(F.col("x"), F.col("y")).alias("node"), "ends_sha256"))


def prefix_trie(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", lent: Column | None = None, lender: Column | None = None) -> DataFrame:
    """The nodes of the prefix trie of the conversations of ``df``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of first turns (role, text; nulls are empty), conv_id its smallest member.  Turns come by turn, null first, and where
    that is equal by the MD5 of role and text; repeated rows are turns of their own.  ``lent`` and ``lender``, columns of ``c`` (the id), rebuild each
    conversation: the first ``lent`` (LENT or fewer) turns of the conversation ``lender``, then its own after as many.  Rows without an id (whole numbers)
    belong to no conversation and are left out.  An empty table has no conversation and gives an empty result.
    """
    spark = df.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    dig = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    turns = df.select(F.col(id_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), dig.alias("dig"), F.char_length(text).cast("long").alias("len")).filter("c IS NOT NULL")
    rows = ranked(scratch.table(turns, "trie-turns"))
    zero = F.lit(0)
    lent, lender = zero if lent is None else lent, F.col("c") if lender is None else lender
    convs = scratch.table(rows.groupBy("c").agg(F.count("*").alias("own")).select("c", "own", lent.cast("int").alias("h"), lender.alias("lender")), "trie-convs")
    offered = rows.filter(F.col("r") < LENT).join(convs.filter("h > 0").select(F.col("lender").alias("c")).distinct(), "c", "left_semi")
    offered = offered.groupBy(F.col("c").alias("lender")).agg(F.sort_array(F.collect_list(F.struct("r", "dig", "len"))).alias("first"))
    heads = convs.join(offered, "lender", "left").withColumn("first", F.slice(F.coalesce("first", F.array().cast("array<struct<r:bigint,dig:binary,len:bigint>>")), F.lit(1), F.col("h")))
    heads = heads.select("c", "own", "h", F.size("first").alias("got"), (F.size("first") + F.greatest(F.col("own") - F.col("h"), zero)).cast("long").alias("L"), "first")
    heads = scratch.table(heads, "trie-heads")
    mine = join_hot(rows, heads.select("c", "own", "h", "got", "L"), "c", "own", "r").filter("r >= h")
    taken = heads.filter("got > 0").select("c", "L", F.posexplode("first").alias("pos", "t")).select("c", "L", F.col("pos").cast("long").alias("pos"), "t.dig", "t.len")
    rebuilt = mine.select("c", "L", (F.col("r") - F.col("h") + F.col("got")).alias("pos"), "dig", "len").unionByName(taken)
    blocks = scratch.table(blocks_of(rebuilt), "trie-prefixes")

    all_convs = heads.agg(F.min("c").alias("owner"), F.count("*").alias("n"))
    units = scratch.table(units_of(blocks, F.col("n"), all_convs), "trie-units")
    to = F.col("depth") + F.size("lens") - 1
    root = named_(F.lit(0).cast("long"), F.lit(0).cast("long"))
    groups = units.groupBy("node").agg(F.min("c").alias("owner"), F.count("*").alias("n"), F.count_if(F.col("L") == to).alias("ending"), F.min("depth").alias("depth"), F.min("cum").alias("cum"))
    groups = scratch.table(groups, "trie-groups")
    begins = F.min(F.struct("depth", "cum")).alias("b")
    owned = groups.groupBy(F.col("owner").alias("c")).agg(begins, F.max((F.col("n") == F.col("ending")).cast("int")).alias("leaf"))
    lengths = blocks.groupBy("c").agg(F.sum(F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["len"])).alias("total"))
    facts = heads.select("c", "L").join(lengths, "c", "left").join(owned, "c", "left")
    facts = facts.select("c", "L", F.coalesce("b.depth", F.lit(1 << 62)).alias("since"), F.coalesce("b.cum", "total", zero).alias("shared"), F.coalesce("leaf", zero).alias("leaf"))
    facts = scratch.table(facts, "trie-facts")
    known = join_hot(units, facts.withColumnRenamed("L", "weight"), "c", "weight", "depth")
    kids = F.count_if((F.col("since") <= to + 1) & (F.col("L") > to))
    least = F.min(F.struct("c", "since", "shared")).alias("o")
    made = known.groupBy("node").agg(least, F.count("*").alias("n"), F.sum("shared").alias("shared"), F.sum("leaf").alias("leaves"), kids.alias("kids"),
                                     *[F.first(c).alias(c) for c in ("parent", "depth", "cum", "lens")])
    made = scratch.table(made, "trie-nodes")
    # A parent that the owner doesn't own itself has another owner.
    parents = groups.select(F.col("node").alias("parent"), F.col("owner").alias("above"), "n")
    parents = scratch.table(parents.unionByName(all_convs.filter("n > 0").select(root.alias("parent"), F.col("owner").alias("above"), "n")), "trie-parents")
    first = made.filter("o.since = depth").select("parent", "node")
    above = join_hot(first, parents, "parent", "n", "node").select("node", "above")
    ends = units.filter(F.col("L") == to).select("node", "c").unionByName(heads.filter("L = 0").select(root.alias("node"), "c"))
    told = made.join(above, "node", "left").join(ends_digests(scratch.table(ends, "trie-ends")), "node", "left")
    each = told.select("o", "n", "shared", "leaves", "kids", "depth", "cum", "lens", "above", "ends_sha256", F.posexplode("lens").alias("i", "_"))
    last, top = F.col("i") == F.size("lens") - 1, F.col("i") == 0
    before = F.aggregate(F.slice("lens", F.lit(1), F.col("i")), F.col("cum"), lambda a, x: a + x)
    nodes = each.select(
        F.col("o.c").alias("conv_id"), (F.col("depth") + F.col("i")).cast("long").alias("depth"), F.when(top, F.coalesce("above", "o.c")).otherwise(F.col("o.c")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").cast("long").alias("n_leaves"),
        (F.col("shared") - F.col("o.shared") - (F.col("n") - 1) * before).alias("saved_tokens"), F.when(last, F.coalesce("ends_sha256", F.lit(EMPTY))).otherwise(F.lit(EMPTY)).alias("ends_sha256"))
    tops = facts.agg(F.min(F.struct("c", "shared")).alias("o"), F.count("*").alias("n"), F.count_if((F.col("since") <= 1) & (F.col("L") > 0)).alias("kids"), F.sum("leaf").alias("leaves"), F.sum("shared").alias("shared"))
    ended = ends_digests(scratch.table(ends.filter(F.col("node") == root), "trie-root-ends")).select("ends_sha256")
    tops = tops.filter("n > 0").crossJoin(F.broadcast(ended.agg(F.max("ends_sha256").alias("ends_sha256"))))  # one row each
    return nodes.unionByName(tops.select(
        F.col("o.c").alias("conv_id"), zero.cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").cast("long").alias("n_children"),
        F.when(F.col("kids") == 0, F.lit(1)).otherwise(F.col("leaves")).cast("long").alias("n_leaves"), (F.col("shared") - F.col("o.shared")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")))
