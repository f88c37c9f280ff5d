"""Texts with similar sets of word shingles, found with a forest of sorted minimum-hash signatures.

Each tree of the forest is an order of minimum hashes; a region of it are the sets that agree in its first DEPTH ones.  Two sets with a Jaccard
similarity of SIMILAR share a region of the TREES trees but for one pair in a million.  First neighbours are linked: those with the longest common
prefix in a few whole orders, each link checked on both sets, which makes one class of most
copies.  Then every region that still has several classes is searched for links between them.  Depth is chosen by region: one with
few sets is searched as it is, a crowded one is dealt anew by the more and deeper trees of the next of LEVELS, where unlike sets part, so
that rows follow the sets and not the pairs of a region.  Where one class makes up nearly all of a crowded region, its members are dealt to parts, each
of which meets the few others.  No links between sets of different classes are passed over, and none is taken unchecked.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest, xxh64_intdigest

from lumenframe.llm import scratch
from lumenframe.llm import text as T
from lumenframe.llm.components import components
from lumenframe.llm.simhash import SEED, BKTree, majority, with_last
from lumenframe.llm.skew import join_hot

SIMILAR = 0.8
#: Trees and depth of each level; (1 - 0.8^depth)^trees is about a millionth.
LEVELS = ((26, 4), (59, 7), (194, 12))
TREES, DEPTH = LEVELS[0]
#: Whole orders in which neighbours are compared, the hashes of their keys, and the neighbours of each set.
ORDERS, KEY_HASHES, NEIGHBOURS = 3, 12, 32
#: A sketch has two bits of each of SLOTS minimum hashes.  At SIMILAR 109 agree on average, with a deviation of 4.
SLOTS, AGREEING = 128, 88
#: Sets of a region that are searched together.
LARGEST = 512
#: What a set brings to a region: its node, class, size, the region, all its regions, its sketch and SimHash.
MEMBER = ["node", "root", "size", "shard", "keys", "sketch", "fp"]
MEMBERS = "node long, root long, size long, shard long, keys array<long>, sketch array<long>, fp long"
#: Bytes of text for each reducer, about.
TASK_BYTES = 32 << 20
_LOW_BITS = 0x5555555555555555
_ALL_LOW_BITS = int.from_bytes(b"\x55" * (SLOTS // 4), "little")


def draws(level: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and flips of ``count`` hash functions of a level."""
    rng = np.random.default_rng((SEED, level))
    return rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's shingles, sorted, one text after the other, and the size of each set."""
    plain = pc.ascii_trim(pc.replace_substring_regex(pc.ascii_lower(texts), "[\\x20\\x09-\\x0D]+", " "), " ")
    sets, sizes = [np.zeros(0, np.uint64)], np.zeros(len(plain), np.int64)
    for i, text in enumerate(plain):
        data = text.as_buffer().to_pybytes()
        if not data:
            continue
        gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32).tolist()
        starts, ends = [0, *[g + 1 for g in gaps]], [*gaps, len(data)]
        last = ends[shingle - 1 :] or ends[-1:]
        own = np.unique(np.array([xxh64_intdigest(data[s:e], SEED) for s, e in zip(starts, last, strict=False)], np.uint64))
        sets.append(own)
        sizes[i] = len(own)
    return np.concatenate(sets), sizes


def signatures(hashes: np.ndarray, sizes: np.ndarray, level: int, count: int) -> np.ndarray:
    """A row of ``count`` minimum hashes (32 bits) for each set; all ones for an empty one."""
    mult, flip = draws(level, count)
    full = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[full]
    out = np.full((len(sizes), count), 0xFFFFFFFF, np.uint32)
    if len(full):
        for k in range(count):
            out[full, k] = np.minimum.reduceat((hashes ^ flip[k]) * mult[k], starts) >> np.uint64(32)
    return out


def region_keys(least: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """A key of each tree's first ``depth`` minimum hashes."""
    keys = np.arange(1, trees + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.zeros((len(least), 1), np.uint64)
    for d in range(depth):
        keys = (keys ^ least[:, d : trees * depth : depth].astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()).cast(kind))


def raw(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    return pa.array([v.tobytes() for v in np.ascontiguousarray(values)], pa.binary())


def sketches(least: np.ndarray) -> np.ndarray:
    """Two bits of each of SLOTS minimum hashes, four 64-bit numbers a row."""
    bits = ((least[:, :SLOTS, None] >> np.array([7, 19], np.uint32)) & 1).astype(np.uint8)
    return np.packbits(bits.reshape(len(least), -1), axis=1).view(np.int64)


def marks(rows: DataFrame, shingle: int, simhash: bool) -> DataFrame:
    """Each row (id, t, text) without its text: id, t, s (128 bits that name its set), size, shards, orders, sketch and fp (SimHash of the set, or null)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotations = [(np.arange(KEY_HASHES) + i * DEPTH * (TREES // ORDERS)) % SLOTS for i in range(ORDERS)]
        for b in T.slices(batches, limit=T.SLICE_BYTES // 4):
            hashes, sizes = shingle_sets(b.column("text"), shingle)
            least = signatures(hashes, sizes, 0, max(SLOTS, TREES * DEPTH))
            ends = np.cumsum(sizes)
            names = [xxh3_128_intdigest(hashes[e - n : e].tobytes()) for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            names = np.array([(x >> 64, x & 0xFFFFFFFFFFFFFFFF) for x in names], np.uint64).reshape(-1, 2).view(np.int64)
            orders = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * ORDERS), raw(np.stack([least[:, r] for r in rotations], 1).astype(">u4").reshape(-1, KEY_HASHES)))
            fp = pa.array(majority(hashes, sizes).view(np.int64)) if simhash else pa.nulls(len(sizes), pa.int64())
            name = pa.StructArray.from_arrays([pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy())], names=["x", "y"])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("t"), name, pa.array(sizes), lists(region_keys(least, TREES, DEPTH), pa.int64()), orders, lists(sketches(least), pa.int64()), fp],
                                             ["id", "t", "s", "size", "shards", "orders", "sketch", "fp"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(digest, f"id {kind}, t struct<x:long,y:long>, s struct<x:long,y:long>, size long, shards array<long>, orders array<binary>, sketch array<long>, fp long")


def sets_of(rows: DataFrame, shingle: int) -> DataFrame:
    """``node`` and ``set`` (the sorted hashes of the shingles) of each row (node, text)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches, limit=T.SLICE_BYTES // 4):
            hashes, sizes = shingle_sets(b.column("text"), shingle)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64)))], ["node", "set"])

    return rows.mapInArrow(hashed, "node long, set array<long>")


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The rows of each run of equal ``key``, across batches."""
    rest = None
    for last, b in with_last(batches):
        if rest is not None:
            b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
        cuts = [0, *(np.flatnonzero(np.diff(b.column(key).to_numpy()) != 0) + 1).tolist(), b.num_rows]
        if not last:
            rest, cuts = b.slice(cuts[-2]), cuts[:-1]
        yield from (b.slice(s, e - s) for s, e in zip(cuts, cuts[1:], strict=False))


class Roots:
    """Which of some numbered things are joined."""

    def __init__(self, n: int) -> None:
        self.root = list(range(n))

    def top(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether they weren't joined before."""
        a, b = self.top(i), self.top(j)
        self.root[max(a, b)] = min(a, b)
        return a != b


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of hashes have a Jaccard similarity of SIMILAR or more (100 * shared >= 80 * joined)."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= round(100 * SIMILAR) * (len(both) - shared)


def fits(n: int, m: int) -> bool:
    """Whether sets of such sizes can be similar."""
    return 100 * min(n, m) >= round(100 * SIMILAR) * max(n, m)


def numbered(rows: pa.Array) -> np.ndarray:
    """Sketches as rows of four 64-bit numbers."""
    return rows.flatten().to_numpy().view(np.uint64).reshape(len(rows), -1)


def differing(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """In how many slots a sketch differs from each of others."""
    x = one ^ others
    return np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(_LOW_BITS)).sum(axis=1, dtype=np.int64)


def near_sketches(group: pa.RecordBatch) -> np.ndarray:
    """Rows (slots that differ, i, j) of the pairs of a group whose sketches may be those of similar sets of different classes."""
    roots, sketch, out = group.column("root").to_numpy(), numbered(group.column("sketch")), [np.zeros((0, 3), np.int64)]
    for i in range(1, len(roots)):
        slots = differing(sketch[i], sketch[:i])
        j = np.flatnonzero((roots[:i] != roots[i]) & (slots <= SLOTS - AGREEING))
        out.append(np.column_stack([slots[j], np.full(len(j), i), j]))
    return np.concatenate(out)


def plausible(group: pa.RecordBatch, near: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Rows (distance, i, j) that ``near`` gives, of those whose sizes fit and whose least common region this is, the nearest first.

    Sets that share several regions are so looked at in one of them; of regions with the same members the least is kept.
    """
    pairs, size, shard = near(group), group.column("size").to_numpy(), group.column("shard")[0].as_py()
    one, other = size[pairs[:, 1]], size[pairs[:, 2]]
    pairs = pairs[100 * np.minimum(one, other) >= round(100 * SIMILAR) * np.maximum(one, other)]
    keys, here = group.column("keys").flatten().to_numpy().reshape(group.num_rows, -1), []
    for start in range(0, len(pairs), 4096):
        a, b = keys[pairs[start : start + 4096, 1]], keys[pairs[start : start + 4096, 2]]
        here.append(np.where(a == b, a, np.iinfo(np.int64).max).min(axis=1) == shard)
    pairs = pairs[np.concatenate(here)] if here else pairs
    return pairs[np.argsort(pairs[:, 0], kind="stable")]


def reducers(df: DataFrame, size: int) -> int:
    return max(scratch.partitions(df.sparkSession), math.ceil(size / TASK_BYTES))


def neighbours(rows: DataFrame, parts: int, radius: int | None = None) -> DataFrame:
    """Pairs a, b of sets that are neighbours in one of ORDERS sorted orders of signatures, and ``top``, a set that b is joined to by such pairs of its task.

    ``rows`` has node, size, sketch, orders and perhaps set.  Each order is sorted in ranges; a task compares each set with the NEIGHBOURS before it that share the
    first DEPTH hashes, which have the longest common prefixes: by sketches, and where there are sets by those, passing over neighbours that it is
    joined to already.  A task holds one batch and the neighbours.

    With a ``radius`` no sketch is looked at: the sets that share the first hashes stand in BK-trees of their SimHashes (``fp``), each with NEIGHBOURS to twice as many
    of those before, and what a tree gives within the radius is compared, the nearest first.
    """
    checked = "set" in rows.columns

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, held, here = BKTree(), [], None  # [node, size, set, top, fp]
        for b in batches:
            found, fps = [], b.column("fp").to_numpy().view(np.uint64).tolist()
            values = lambda i, data=b.column("set") if checked else None: data[i].values.to_numpy() if checked else None
            for i, (o, key, node, size) in enumerate(zip(*(b.column(c).to_pylist() for c in ("o", "key", "node", "size")), strict=True)):
                own, region, fp, top = values(i), (o, key[: 4 * DEPTH]), fps[i], node
                if region != here or len(held) == 2 * NEIGHBOURS:
                    tree, held, here = BKTree(), held[-NEIGHBOURS:] if region == here else [], region
                    for other in held:
                        tree.add(other[4])
                for _, j in sorted(((fp ^ held[j][4]).bit_count(), -j) for j in tree.within(fp, radius)):
                    other = held[-j]
                    if other[3] != top and fits(size, other[1]) and (not checked or similar(own, other[2])):
                        found.append((node, other[0], other[3]))
                        gone = other[3]
                        for each in held:
                            if each[3] == gone:
                                each[3] = top
                tree.add(fp)
                held.append([node, size, own.copy() if checked else None, top, fp])
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], ["a", "b", "top"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: deque = deque(maxlen=NEIGHBOURS)  # [region, node, size, sketch, set, top]
        for b in batches:
            found, sketch = [], numbered(b.column("sketch"))
            values = lambda i, data=b.column("set") if checked else None: data[i].values.to_numpy() if checked else None
            for i, (o, key, node, size) in enumerate(zip(*(b.column(c).to_pylist() for c in ("o", "key", "node", "size")), strict=True)):
                own, region, bits, top = values(i), (o, key[: 4 * DEPTH]), int.from_bytes(sketch[i].tobytes(), "little"), node
                for other in reversed(last):
                    if other[0] != region:
                        break
                    x = bits ^ other[3]
                    if other[5] != top and fits(size, other[2]) and ((x | x >> 1) & _ALL_LOW_BITS).bit_count() <= SLOTS - AGREEING and (not checked or similar(own, other[4])):
                        found.append((node, other[1], other[5]))
                        gone = other[5]
                        for each in last:
                            if each[5] == gone:
                                each[5] = top
                last.append([region, node, size, bits, own.copy() if checked else None, top])
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], ["a", "b", "top"])

    each = rows.select("node", "size", "sketch" if radius is None else "fp", *["set"] * checked, F.posexplode("orders").alias("o", "key"))
    return each.repartitionByRange(parts, "o", "key", "node").sortWithinPartitions("o", "key", "node").mapInArrow(walk if radius is None else climb, "a long, b long, top long")


def apart(one: Column, other: Column) -> Column:
    """In how many slots two sketches differ."""
    low = F.lit(_LOW_BITS)
    return F.aggregate(F.zip_with(one, other, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda n, x: n + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(low)))


def agreement(slots: int) -> float:
    """The greatest Jaccard similarity of sets whose sketches differ in so many slots, but for one case in a million."""
    p = np.linspace(0.25, 1, 751)
    likely = p * SLOTS - 5 * np.sqrt(p * (1 - p) * SLOTS) <= SLOTS - slots
    return float((4 * p[likely].max() - 1) / 3) if likely.any() else 0.0


def least_agreement(slots: int) -> float:
    """The least similarity of such sets, in the same sense."""
    p = np.linspace(0.25, 1, 751)
    likely = p * SLOTS + 5 * np.sqrt(p * (1 - p) * SLOTS) >= SLOTS - slots
    return float((4 * p[likely].min() - 1) / 3)


#: The same for all numbers of slots.
MOST_ALIKE, LEAST_ALIKE = (np.array([f(n) for n in range(SLOTS + 1)]) for f in (agreement, least_agreement))


def meeting_classes(entries: DataFrame, nodes: DataFrame, parts: int) -> DataFrame:
    """shard, root of the classes of each region (shard, root, far, low, high) that may have sets similar to those of another.

    The distance 1 - similarity is a metric: two classes whose roots are further apart than 1 - SIMILAR and the reaches of both (how far their sets are from the root)
    have no similar sets.  Distances are bounded from sketches.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, "shard"):
            root, sketch = g.column("root").to_numpy(), numbered(g.column("sketch"))
            reach = np.where(g.column("alone").to_numpy(zero_copy_only=False), 0.0, 1 - LEAST_ALIKE[g.column("far").to_numpy()])
            low, high = g.column("low").to_numpy(), g.column("high").to_numpy()
            met = np.zeros(len(root), bool)
            for i in range(1, len(root)):
                alike = MOST_ALIKE[differing(sketch[i], sketch[:i])] >= SIMILAR - 1e-9 - reach[i] - reach[:i]
                alike &= (100 * high[:i] >= round(100 * SIMILAR) * low[i]) & (100 * high[i] >= round(100 * SIMILAR) * low[:i])
                met[i] |= alike.any()
                met[:i] |= alike
            yield pa.RecordBatch.from_arrays([g.column("shard").filter(pa.array(met)), pa.array(root[met])], ["shard", "root"])

    rows = entries.join(nodes.select(F.col("node").alias("root"), "sketch"), "root").select("shard", "root", "far", "alone", "low", "high", "sketch")
    return rows.repartition(parts, "shard").sortWithinPartitions("shard", "root").mapInArrow(search, "shard long, root long")


def open_regions(nodes: DataFrame, roots: DataFrame, parts: int, largest: int = LARGEST) -> DataFrame:
    """Members (shard, node, size, root, n, most, top) of the regions in which several classes may have similar sets; regions with the same members count once.

    Most groups of copies are one class, and go no further.  Of a region of up to ``largest`` classes those that no other comes near to go no
    further either, however many sets they have.
    """
    sizes = scratch.table(roots.groupBy("root").agg(F.count("*").alias("sets")), "forest-class-sizes")
    tops = sizes.join(nodes.select(F.col("node").alias("root"), F.col("sketch").alias("top_sketch")), "root")
    linked = join_hot(roots.join(nodes.select("node", "sketch"), "node"), scratch.table(tops, "forest-tops"), "root", "sets", "node")
    linked = linked.select("node", "root", apart(F.col("sketch"), F.col("top_sketch")).alias("far"))
    rooted = nodes.select("node", "size", "shards").join(linked, "node", "left")
    rooted = scratch.table(rooted.select("node", "size", F.coalesce("root", "node").alias("root"), F.coalesce("far", F.lit(0)).alias("far"), "shards"), "forest-rooted")
    each = rooted.select("node", "size", "root", "far", F.explode("shards").alias("shard"))
    who = [F.bit_xor(F.xxhash64(*salt, "node")).alias(f"w{i}") for i, salt in enumerate(([], [F.lit(1)]))]
    counted = each.groupBy("shard").agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1"), *who).filter("r0 < r1")
    kept = scratch.table(counted.groupBy("n", "w0", "w1").agg(F.min("shard").alias("shard")).select("shard"), "forest-kept")
    of_class = each.groupBy("shard", "root").agg(F.count("*").alias("m"), F.max("far").alias("far"), F.min("size").alias("low"), F.max("size").alias("high"),
                                               F.bool_and(F.col("node") == F.col("root")).alias("alone"))
    entries = scratch.table(of_class.join(kept, "shard"), "forest-entries")
    many = scratch.table(entries.groupBy("shard").agg(F.count("*").alias("classes")), "forest-entry-counts")
    told = join_hot(entries, many, "shard", "classes", "root")
    near = meeting_classes(told.filter(F.col("classes") <= largest), nodes, parts).unionByName(told.filter(F.col("classes") > largest).select("shard", "root"))
    near = scratch.table(near.join(entries.select("shard", "root", "m"), ["shard", "root"]), "forest-open-classes")
    largest_of = near.groupBy("shard").agg(F.sum("m").alias("n"), F.max(F.struct("m", "root")).alias("t"), F.count("*").alias("classes")).filter("classes > 1")
    largest_of = scratch.table(largest_of.select("shard", "n", F.col("t.m").alias("most"), F.col("t.root").alias("top"), "classes"), "forest-open-regions")
    place = F.xxhash64("shard", "root").alias("place")
    open_ = join_hot(near, largest_of, "shard", "classes", "root").select(place, F.col("shard").alias("s"), F.col("root").alias("r"), "m", "n", "most", "top")
    # Only the node travels: were two places ever one hash, a node would meet sets whose region isn't among its keys, and no pair would be looked at.
    members = join_hot(each.select("node", place), scratch.table(open_, "forest-open"), "place", "m", "node").select(F.col("s").alias("shard"), F.col("r").alias("root"), "node", "n", "most", "top")
    return with_keys(members, rooted.select("node", "size", "shards"), nodes)


def with_keys(members: DataFrame, dealt: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stored ``members`` with ``keys``, all regions of the node as ``dealt`` (node, shards, ...) has them, and its sketch and fp; a node is in as many regions as there are trees at most."""
    told = dealt.withColumnRenamed("shards", "keys").join(nodes.select("node", "sketch", "fp"), "node")
    return scratch.table(members.join(told, "node"), "forest-members")


def deeper(rest: DataFrame, nodes: DataFrame, sets: DataFrame, level: int, parts: int) -> DataFrame:
    """The sets of crowded regions dealt anew: members (shard, n, node, size, root, most, top, keys) of the regions of several classes of the trees of ``level``; those with the same members count once."""
    trees, depth = LEVELS[level]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                s = b.slice(i, 256)
                flat = s.column("set").flatten().to_numpy().view(np.uint64)
                sizes = pc.list_value_length(s.column("set")).to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([*[s.column(c) for c in ("node", "size", "root")], lists(region_keys(signatures(flat, sizes, level, trees * depth), trees, depth), pa.int64())], ["node", "size", "root", "shards"])

    hot = rest.select("node", "size", "root").distinct().join(sets, "node").repartition(parts)
    dealt = scratch.table(hot.mapInArrow(deal, "node long, size long, root long, shards array<long>"), "forest-deeper")
    each = dealt.select("node", "size", "root", F.explode("shards").alias("shard"))
    of_class = each.groupBy("shard", "root").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("w0"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("w1"))
    of_shard = of_class.groupBy("shard").agg(F.sum("m").alias("n"), F.max(F.struct("m", "root")).alias("t"), F.count("*").alias("classes"), F.bit_xor("w0").alias("w0"), F.bit_xor("w1").alias("w1"))
    once = of_shard.filter("classes > 1").groupBy("n", "w0", "w1").agg(F.min(F.struct("shard", "t")).alias("s"))
    kept = scratch.table(once.select(F.col("s.shard").alias("shard"), "n", F.col("s.t.m").alias("most"), F.col("s.t.root").alias("top")), "forest-kept")
    return with_keys(join_hot(each, kept, "shard", "n", "node"), dealt.select("node", "shards"), nodes)


def cells(members: DataFrame, nodes: DataFrame, sets: DataFrame, parts: int, largest: int = LARGEST) -> DataFrame:
    """``cell`` and the columns of MEMBER: groups of about ``largest`` sets at most in which any two of a region and of different classes meet.

    ``members`` (stored) has those columns, n, most and top.  After the last level a region that is crowded still is laid out
    in blocks, each two of which meet.
    """
    part = largest // 2
    columns = ["cell", *MEMBER]
    out = None
    for level in range(1, len(LEVELS) + 1):
        few = F.col("n") - F.col("most") <= part
        k = F.ceil(F.col("most") / part).cast("int")
        own = F.pmod(F.xxhash64("node", "shard"), k).cast("int")
        every = F.when(F.col("n") <= largest, F.array(F.lit(0))).when(F.col("root") == F.col("top"), F.array(own)).otherwise(F.sequence(F.lit(0), k - 1))
        met = members.filter((F.col("n") <= largest) | few).withColumn("part", F.explode(every)).withColumn("cell", F.xxhash64("shard", "part", F.lit(level)))
        out = met.select(*columns) if out is None else out.unionByName(met.select(*columns))
        rest = members.filter((F.col("n") > largest) & ~few)
        if not rest.limit(1).count():
            return out
        if level < len(LEVELS):
            members = deeper(rest, nodes, sets, level, parts)
    blocks = F.ceil(F.col("n") / part).cast("int")
    laid = rest.withColumn("own", F.pmod(F.xxhash64("node", "shard"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return out.unionByName(laid.withColumn("cell", F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other"))).select(*columns))


def candidates(met: DataFrame, parts: int, near: Callable) -> DataFrame:
    """Those of each cell (cell and MEMBER) that may be similar to one of another class."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, "cell"):
            held = np.unique(plausible(g, near)[:, 1:])
            if len(held):
                yield g.select(["cell", *MEMBER]).take(pa.array(held))

    return met.repartition(parts, "cell").sortWithinPartitions("cell", "node").mapInArrow(search, f"cell long, {MEMBERS}")


def class_links(met: DataFrame, sets: DataFrame, parts: int, near: Callable) -> DataFrame:
    """Links (a, b sets, ra, rb their classes) that join the similar sets of different classes in each cell, the nearest pairs first."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, "cell"):
            node, root = (g.column(c).to_pylist() for c in ("node", "root"))
            joined, first, found = Roots(len(node)), {}, []
            for i, r in enumerate(root):
                joined.join(i, first.setdefault(r, i))
            values, held = g.column("set"), {}
            own = lambda i, values=values, held=held: held.get(i) or held.setdefault(i, frozenset(values[i].values.to_numpy().tolist()))
            for _, i, j in plausible(g, near).tolist():
                if joined.top(i) != joined.top(j):
                    shared = len(own(i) & own(j))
                    if 100 * shared >= round(100 * SIMILAR) * (len(own(i)) + len(own(j)) - shared):
                        joined.join(i, j)
                        found.append((node[i], node[j], root[i], root[j]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(4)], ["a", "b", "ra", "rb"])

    whole = met.join(sets, "node")
    return whole.repartition(parts, "cell").sortWithinPartitions("cell", "node").mapInArrow(search, "a long, b long, ra long, rb long")


def links(nodes: DataFrame, texts: Callable[[DataFrame], DataFrame], shingle: int, parts: int, near: Callable = near_sketches, largest: int = LARGEST, radius: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links that join all similar ``nodes`` (stored: node, size, shards, orders, sketch, fp): those of neighbours (a, b, top), the classes that they make (node, root), and links between those (a, b, ra, rb).

    ``texts`` gives (node, text) of some nodes; ``near`` the pairs of a group of sets that are worth a check, and ``radius`` makes neighbours those of BK-trees.
    """
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = scratch.table(ends(neighbours(nodes, parts, radius)), "forest-asked")
    sets = scratch.table(sets_of(texts(asked), shingle), "forest-sets")
    first = scratch.table(neighbours(sets.join(nodes, "node"), parts, radius).distinct(), "forest-near")
    roots = scratch.table(components(first.select("a", F.col("top").alias("b"))), "forest-first-roots")
    regions = open_regions(nodes, roots, parts, largest)
    hot = regions.filter((F.col("n") > largest) & (F.col("n") - F.col("most") > largest // 2)).select("node").distinct()
    crowded = hot.limit(1).count() > 0
    hot_sets = with_sets(scratch.table(hot, "forest-hot"), sets, texts, shingle, "forest-hot-sets") if crowded else sets
    met = scratch.table(cells(regions, nodes, hot_sets, parts, largest), "forest-cells")
    likely = scratch.table(candidates(met, parts, near), "forest-candidates")
    whole = with_sets(likely.select("node").distinct(), sets, texts, shingle, "forest-likely-sets")
    return first, roots, scratch.table(class_links(likely, whole, parts, near), "forest-links")


def classes(nodes: DataFrame, first: DataFrame, roots: DataFrame, second: DataFrame) -> DataFrame:
    """``node`` and ``root``, the same for all that the links of neighbours (``first``, in ``roots``) and those between their classes join."""
    roots = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    joined = components(second.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    sizes = scratch.table(roots.groupBy("root").agg(F.count("*").alias("n")).join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root"), "forest-joined")
    return join_hot(roots, sizes, "root", "n", "node", "left").select("node", F.coalesce("top", "root").alias("root"))


def with_sets(some: DataFrame, known: DataFrame, texts: Callable[[DataFrame], DataFrame], shingle: int, name: str) -> DataFrame:
    """The sets of ``some`` nodes: those that are known, and the others from their texts."""
    missing = scratch.table(some.join(known, "node", "left_anti"), f"{name}-missing")
    if not missing.limit(1).count():
        return known
    return known.unionByName(scratch.table(sets_of(texts(missing), shingle), name))


def similar_groups(df: DataFrame, id_col: str, text_col: str, shingle: int, near: Callable = near_sketches, radius: int | None = None, empty_alike: bool = False) -> DataFrame:
    """Each row of ``df`` as id, t (128 bits that name its text), size (of its set), least_id and least_t (those of the first row of its component, null ids last).

    Rows with empty sets are each alone, unless they are ``empty_alike``.  A ``radius`` makes first neighbours those of BK-trees of SimHashes.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.select("id", text_name(F.col("text")).alias("t"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = reducers(df, total)
    marked = scratch.table(marks(rows, shingle, radius is not None), "forest")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t")).alias("m")
    some = F.lit(True) if empty_alike else F.col("size") > 0
    nodes = marked.filter(some).groupBy("s").agg(first, F.count("*").alias("uses"), *[F.first(c).alias(c) for c in ("size", "shards", "orders", "sketch", "fp")])
    nodes = scratch.table(nodes.withColumn("node", F.monotonically_increasing_id()), "forest-nodes")

    def texts(some: DataFrame) -> DataFrame:
        named = nodes.join(some, "node", "left_semi").select("node", F.col("m.id").alias("nid"), F.col("m.t").alias("nt"))
        own = rows.join(named, (F.col("t") == F.col("nt")) & F.col("id").eqNullSafe(F.col("nid")))
        return own.groupBy("node").agg(F.first("text").alias("text"))  # rows may repeat

    roots = classes(nodes, *links(nodes, texts, shingle, parts, near, radius=radius))
    rooted = scratch.table(nodes.select("s", "uses", "node", "m").join(roots, "node").select("s", "uses", "root", "m"), "forest-roots")
    lowest = rooted.groupBy("root").agg(F.min("m").alias("m"), F.count("*").alias("sets")).select("root", "sets", F.col("m.id").alias("least_id"), F.col("m.t").alias("least_t"))
    lowest = scratch.table(lowest, "forest-lowest")
    told = scratch.table(join_hot(rooted.select("s", "uses", "root"), lowest, "root", "sets", "s").select("s", "uses", "least_id", "least_t"), "forest-told")
    full = join_hot(marked.filter(some).select("id", "t", "s", "size"), told, "s", "uses", "id")
    if empty_alike:
        return full.select("id", "t", "size", "least_id", "least_t")
    return full.select("id", "t", "size", "least_id", "least_t").unionByName(marked.filter(~some).select("id", "t", "size", F.col("id").alias("least_id"), F.col("t").alias("least_t")))


def text_name(text: Column) -> Column:
    """128 bits of a text, as a struct of two numbers."""
    return F.struct(F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 2) -> DataFrame:
    """The id, n_shingles, component_id and kept of each row of ``df``: sets of word shingles linked at a Jaccard similarity of SIMILAR or more.

    Texts are lower-cased (A-Z only) and cut into words at ASCII white space; with fewer words than a shingle the whole sequence is one, and a
    text without words (null too) has an empty set, linked with nothing.  component_id is the smallest id reachable; null ids are passed over, and it is null
    where there are only such.  ``kept`` tells whether the id is component_id; rows that repeat an id are rows of their own.  An empty
    table gives an empty result.
    """
    found = similar_groups(df, id_col, text_col, shingle)
    return found.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.col("least_id").alias("component_id"), F.col("id").eqNullSafe(F.col("least_id")).alias("kept"))
