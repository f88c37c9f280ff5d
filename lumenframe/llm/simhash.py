"""SimHash near-duplicates: 64-bit fingerprints, BK-trees over shards of them, and connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lumenframe.llm import scratch
from lumenframe.llm import text as T
from lumenframe.llm.components import components
from lumenframe.llm.skew import hot_keys, join_hot

SEED = 42
SHINGLE = 3
RADIUS = 2
#: The 64 bits are cut into RADIUS + 2 blocks: RADIUS differing bits leave at least two blocks as they are.
BLOCKS = 4
#: Members above which a shard is split by further blocks.
LARGEST_TREE = 512


def fingerprints(df: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``id``, ``th``, ``fp`` (the fingerprint as a signed long) of each row of ``df`` (id, th, text)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches, limit=T.SLICE_BYTES // 4):
            plain = pc.replace_substring_regex(pc.ascii_lower(b.column("text")), "[\\x20\\x09-\\x0D]+", " ")
            plain = pc.ascii_trim(plain, " ")
            hashes: list[int] = []
            sizes = np.zeros(len(plain), np.int64)
            for i, text in enumerate(plain):
                data = text.as_buffer().to_pybytes()
                if not data:
                    continue
                gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32).tolist()
                starts, ends = [0, *[g + 1 for g in gaps]], [*gaps, len(data)]
                last = ends[shingle - 1 :] or ends[-1:]
                own = [xxh64_intdigest(data[s:e], SEED) for s, e in zip(starts, last, strict=False)]
                hashes += own
                sizes[i] = len(own)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(majority(np.array(hashes, np.uint64), sizes).view(np.int64))], ["id", "th", "fp"])

    return df.mapInArrow(digest, f"id {df.schema['id'].dataType.simpleString()}, th long, fp long")


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of hashes the bits that are set in over half of it; zero for an empty run."""
    counts = np.zeros((len(sizes), 64), np.int64)
    full = np.flatnonzero(sizes)
    at = np.cumsum(sizes) - sizes
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    for i in full.tolist():
        counts[i] = bits[at[i] : at[i] + sizes[i]].sum(axis=0, dtype=np.uint32)
    return np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little").reshape(-1, 8).view("<u8").ravel()


class BKTree:
    """Fingerprints in a tree; a child hangs under its parent by its Hamming distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        if not new:
            return
        node = 0
        while True:
            d = (value ^ self.values[node]).bit_count()
            if (below := self.children[node].get(d)) is None:
                self.children[node][d] = new
                return
            node = below

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Numbers of the members within the radius; only edges from distance - radius to distance + radius are followed."""
        waiting = [0] if self.values else []
        while waiting:
            node = waiting.pop()
            d = (value ^ self.values[node]).bit_count()
            if d <= radius:
                yield node
            for edge, child in self.children[node].items():
                if d - radius <= edge <= d + radius:
                    waiting.append(child)


def tree_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the values, found with a BK-tree."""
    tree, root, links = BKTree(), list(range(len(values))), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, value in enumerate(values):
        for j in tree.within(value, radius):
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((values[j], value))
        tree.add(value)
    return links


def finer(mask: int) -> list[int]:
    """The masks of the shards that a shard is split into: its free bits are cut into BLOCKS blocks, of which any two are fixed too."""
    free = [b for b in range(64) if not mask >> b & 1]
    width = len(free) // BLOCKS
    blocks = [sum(1 << b for b in free[i * width : (i + 1) * width]) for i in range(BLOCKS)]
    return [mask | a | b for a, b in combinations(blocks, 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sharded(rows: DataFrame, masks: Column) -> DataFrame:
    """``fp``, ``mask``, ``shard`` for each of the masks of each row: members of a shard agree in the bits of its mask."""
    out = rows.select("fp", F.explode(masks).alias("mask"))
    return out.withColumn("shard", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))


def links(fps: DataFrame, largest: int = LARGEST_TREE) -> DataFrame:
    """Edges a, b among the distinct fingerprints of ``fps`` that join all within RADIUS bits.

    Fingerprints within the radius differ in at most two of four blocks, so they meet in the shard of two blocks that are equal, and
    every shard is a BK-tree.  A shard of more than ``largest`` members is split in the same way by its free bits: 32 are free
    at first, then 16, then 8, where a shard has at most 256 members.  So any two within the radius meet in a tree, and no tree is large.
    """
    masks, shards, found = [0], fps, None
    while (free := 64 - masks[0].bit_count()) > 8:
        below = {m: finer(m) for m in masks}
        lists = F.create_map(*[c for m, own in below.items() for c in (F.lit(signed(m)), F.array(*[F.lit(signed(x)) for x in own]))])
        shards = sharded(shards, F.element_at(lists, F.col("mask") if "mask" in shards.columns else F.lit(0).cast("long")))
        masks = [x for own in below.values() for x in own]
        if free <= 16:  # at most 256 members each
            return tree_pairs(shards) if found is None else found.unionByName(tree_pairs(shards))
        sizes = scratch.table(shards.groupBy("shard").agg(F.count("*").alias("n")), "simhash-shards")
        large = sizes.filter(F.col("n") > largest)
        told = join_hot(shards, large, "shard", "n", "fp", "left", hot_keys(sizes, "shard", "n"))
        pairs = tree_pairs(told.filter("n IS NULL"))
        found = pairs if found is None else found.unionByName(pairs)
        if not large.limit(1).count():
            break
        shards = scratch.table(told.filter("n IS NOT NULL").drop("n", "shard"), "simhash-large")
    return found


def tree_pairs(shards: DataFrame) -> DataFrame:
    """Edges a, b of each shard (fp, shard), found with its BK-tree."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for last, b in with_last(batches):
            cols = [b.column(c).to_numpy() for c in ("shard", "fp")]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(cols[0]) != 0) + 1])
            ends = np.concatenate([starts[1:], [len(cols[0])]])
            if not last:
                rest = [c[starts[-1] :] for c in cols]
                starts, ends = starts[:-1], ends[:-1]
            found: list[tuple[int, int]] = []
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                found += tree_links(cols[1][s:e].view(np.uint64).tolist(), RADIUS)
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    dealt = shards.select("shard", "fp").repartition(scratch.partitions(shards.sparkSession), "shard").sortWithinPartitions("shard", "fp")
    return dealt.mapInArrow(search, "a long, b long")


def with_last(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Each batch that has rows, and whether it is the last."""
    held = None
    for b in batches:
        if b.num_rows:
            if held is not None:
                yield False, held
            held = b
    if held is not None:
        yield True, held


def grouped(df: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """``id``, ``th`` (a hash of the text), ``fp`` and ``component_id`` of every row of ``df``."""
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.col(text_col).cast("string").alias("text"))
    marked = scratch.table(fingerprints(rows, shingle), "simhash")
    fps = scratch.table(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("uses")), "simhash-distinct")
    roots = components(links(fps))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = scratch.table(rooted, "simhash-roots")
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("uses").alias("members"))
    named = join_hot(rooted, scratch.table(lowest, "simhash-lowest"), "root", "members", "fp")
    named = scratch.table(named.select("fp", "root", "uses", "component_id"), "simhash-named")
    return join_hot(marked, named, "fp", "uses", "id").select("id", "th", "fp", "root", "component_id")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Fingerprint of every row of ``df`` and its component: the id, fingerprint, component_id.

    Texts are lower-cased (A-Z only) and cut into words at ASCII white space; a text of fewer words than a
    shingle is one shingle, and a text without words (null too) has fingerprint zero and is linked like
    any other.  Fingerprints link at RADIUS or fewer differing bits; component_id is the smallest id
    reachable (null ids are passed over; null where there are only such).  Rows that repeat an id
    are rows of their own.  An empty table gives an empty result.
    """
    out = grouped(df, id_col, text_col, shingle)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row of ``df`` for each component, the one with the smallest id, with all its columns.

    Null ids come last; rows that are alike in id and text all stay if one does (``drop_copies`` removes them).
    """
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("m")
    marks = grouped(df, id_col, text_col, shingle).groupBy("root").agg(first).select(F.col("m.id").alias("keep"), F.col("m.th").alias("kept_th"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"))
    return rows.join(marks, F.col("id").eqNullSafe(F.col("keep")) & (F.col("th") == F.col("kept_th")), "left_semi").select("row.*")
