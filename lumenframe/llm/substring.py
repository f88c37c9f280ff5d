"""Exact substring deduplication with fixed-block anchors.

The word sequences of all documents are cut into non-overlapping reference blocks of BLOCK words, the
index.  Every rolling window of BLOCK words probes it.  A repeated window of WINDOW >= 2 * BLOCK - 1 words
always holds a whole block of its earlier place, so the words around hits are the only candidates; hits
are extended to all windows of WINDOW words that hold one, and those are compared by 128 bits made from two
independent hashes of each word, which gives the maximal exact repeats.  (Among 10^13 windows the chance that any two different
ones agree in all bits is below 10^-12.)  Hashes travel packed: one row for each slice of texts and owner of a
hash range, so neither pairs nor groups are ever formed.  Owners grow in number with the bytes of text, so what a
task holds at one time is bounded, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from lumenframe.llm import scratch
from lumenframe.llm import text as T

WINDOW = 20
BLOCK = 10

#: Bytes of text for each reducer and for each owner at most, about; there is an owner for each reducer at least.
TASK_BYTES, OWNED_BYTES = 32 << 20, 4 << 20

#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

PACKED = "owner int, source long, wide boolean, block_hash binary, block_at binary, hash binary, at binary, docs binary"


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolling(values: np.ndarray, size: int, base: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` consecutive values."""
    n = len(values)
    if n < size:
        return np.zeros(0, np.uint64)
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n - size + 1, inverse, np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up, dtype=np.uint64)])
    return mixed((total[size:] - total[:-size]) * down)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word of all texts, and the offsets of each text."""
    flat, bounds = T.words(texts)
    codes, distinct = T.coded(flat)
    hashes = np.frombuffer(b"".join(map(xxh3_128_digest, distinct.to_pylist())), "<u8").reshape(-1, 2)
    return (hashes[codes] if len(codes) else np.zeros((0, 2), np.uint64)), bounds


def first_places(hashes: np.ndarray) -> np.ndarray:
    """Whether each row of two hashes is the first of its kind."""
    order = np.lexsort((hashes[:, 1], hashes[:, 0]))
    ordered = hashes[order]
    new = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(axis=1)]) if len(order) else np.zeros(0, bool)
    first = np.zeros(len(hashes), bool)
    first[order[new]] = True
    return first


def starts_of(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of ``size`` words that lie in one text: place in the row of words, and place in the text."""
    count = np.maximum(0, np.diff(bounds) - size + 1)
    return T.ragged(bounds[:-1], count), T.ragged(np.zeros(len(count), np.int64), count)


def put(places: np.ndarray, wide: bool) -> bytes:
    """Ascending places as steps; of narrow steps first all low, then all high bytes."""
    steps = np.diff(places, prepend=0)
    return steps.astype("<u4").tobytes() if wide else steps.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def got(data: bytes, wide: bool) -> np.ndarray:
    steps = np.frombuffer(data, "<u4") if wide else np.frombuffer(data, np.uint8).reshape(2, -1).T.copy().view("<u2").ravel()
    return np.cumsum(steps, dtype=np.int64)


def runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal keys."""
    if len(keys):
        cuts = np.flatnonzero(np.diff(keys)) + 1
        yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True)


def packed(owner: np.ndarray, places: np.ndarray, hashes: np.ndarray, blocks: np.ndarray, owners: int) -> Iterator[tuple]:
    """A row (owner, wide, block_hash, block_at, hash, at) for each owner that has any of the windows."""
    order = np.argsort(owner.astype(np.uint16 if owners <= 1 << 16 else np.uint32), kind="stable")
    owner, places, hashes, blocks = owner[order], places[order], hashes[order], blocks[order]
    for a, b in runs(owner):
        p, h, block = places[a:b], hashes[a:b], blocks[a:b]
        parts = p[block], p[~block]
        wide = any(len(x) and (x[0] > 0xFFFF or np.diff(x, prepend=x[0]).max() > 0xFFFF) for x in parts)
        yield int(owner[a]), wide, h[block].tobytes(), put(parts[0], wide), h[~block].tobytes(), put(parts[1], wide)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """The rows of each run of equal ``key``, across batches."""
    rows: list[dict] = []
    for b in batches:
        for i in range(b.num_rows):
            row = {n: c[i].as_py() for n, c in zip(b.schema.names, b.columns, strict=True)}
            if rows and rows[0][key] != row[key]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def arrow(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


PACKED_NAMES = ["owner", "source", "wide", "block_hash", "block_at", "hash", "at", "docs"]
PACKED_TYPES = [pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 5]


def anchors(rows: DataFrame, owners: int) -> DataFrame:
    """Index blocks and probes of each slice of ``rows`` (id, th, text), packed by owner, and a row of the slice's documents.

    A slice sends each of its hashes once, from the first place, so a passage that a third of all documents
    have costs its owner one entry a slice.  The further places stay with the slice's documents.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = TaskContext.get().partitionId() << 33
        for b in T.slices(batches):
            values, bounds = word_hashes(b.column("text"))
            at, inside = starts_of(bounds, BLOCK)
            hashes = rolling(values[:, 0], BLOCK, BASES[0])[at]
            first, rest, of_rest = told_apart(hashes)
            block = inside % BLOCK == 0
            indexed = np.zeros(len(first), bool)  # a block is among the places of the hash
            indexed[of_rest[block[rest]]] = True
            indexed |= block[first]
            inner = np.zeros(len(first), bool)  # matched within the slice
            inner[of_rest] = True
            inner &= indexed
            sent = hashes[first]
            owner = (sent >> np.uint64(32)) % np.uint64(owners)
            out = [(o, source, w, bh, ba, h, a, None) for o, w, bh, ba, h, a in packed(owner, at[first], sent.astype(np.uint32), indexed, owners)]
            docs = {"docs": table(id=b.column("id"), th=b.column("th"), first=bounds[:-1]), "again": table(at=at[rest], as_=at[first][of_rest]), "inner": table(at=at[first][inner])}
            out.append((source % owners, source, False, None, None, None, None, pickle.dumps({k: as_bytes(v) for k, v in docs.items()})))
            source += 1
            yield arrow(out, PACKED_NAMES, PACKED_TYPES)

    return rows.mapInArrow(send, PACKED)


def told_apart(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the first place of each hash (ascending), of all other places, and for each of those which first it repeats."""
    order = np.argsort(hashes, kind="stable")
    new = np.concatenate([[True], np.diff(hashes[order]) != 0]) if len(order) else np.zeros(0, bool)
    lead = order[np.flatnonzero(new)]
    group = np.cumsum(new) - 1
    rank = np.empty(len(lead), np.int64)
    rank[np.argsort(lead)] = np.arange(len(lead))
    return np.sort(lead), order[~new], rank[group[~new]]


def table(**columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def as_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_bytes(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def found(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is among the ordered ones."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def split(flags: np.ndarray, parts: list[np.ndarray]) -> list[np.ndarray]:
    return np.split(flags, np.cumsum([len(p) for p in parts])[:-1])


HITS = "source long, wide boolean, at binary, docs binary"
HIT_NAMES, HIT_TYPES = ["source", "wide", "at", "docs"], [pa.int64(), pa.bool_(), pa.binary(), pa.binary()]


def hits(sent: DataFrame, parts: int) -> DataFrame:
    """Places of blocks and probes that some other place matches, by slice; rows of documents pass through."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "owner"):
            out = [(r["source"], False, None, r["docs"]) for r in rows if r["docs"] is not None]
            rows = [r for r in rows if r["docs"] is None]
            if rows:
                block = [np.frombuffer(r["block_hash"], np.uint32) for r in rows]
                probe = [np.frombuffer(r["hash"], np.uint32) for r in rows]
                index, often = np.unique(np.concatenate(block), return_counts=True)
                probed = found(index, np.unique(np.concatenate(probe)))
                met = index[(often > 1) | probed]  # blocks that anything else matches
                good = [split(found(np.concatenate(part), met), part) for part in (block, probe)]
                for r, own_block, own_probe in zip(rows, *good, strict=True):
                    places = np.concatenate([got(r["block_at"], r["wide"])[own_block], got(r["at"], r["wide"])[own_probe]])
                    if len(places):
                        out.append((r["source"], True, put(np.sort(places), True), None))
            yield arrow(out, HIT_NAMES, HIT_TYPES)

    dealt = sent.repartition(parts, "owner").sortWithinPartitions("owner")
    return dealt.mapInArrow(match, HITS)


def per_document(matched: DataFrame, parts: int, id_type: str) -> DataFrame:
    """Hits of each document that has any: id, th, places of the hits in the document."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "source"):
            parts_ = {k: from_bytes(v) for k, v in pickle.loads(next(r["docs"] for r in rows if r["docs"] is not None)).items()}
            docs, again = parts_["docs"], parts_["again"]
            places = np.unique(np.concatenate([parts_["inner"].column("at").to_numpy(), *(got(r["at"], True) for r in rows if r["docs"] is None)]))
            places = np.sort(np.concatenate([places, again.column("at").to_numpy()[found(again.column("as_").to_numpy(), places)]]))
            first = docs.column("first").to_numpy()
            # Empty texts share their first word with the next text; the last of them is the one with words.
            of = np.searchsorted(first, places, side="right") - 1
            spans = list(runs(of))
            own = pa.array([int(of[a]) for a, _ in spans], pa.int64())
            data = [(places[a:b] - first[of[a]]).astype("<u4").tobytes() for a, b in spans]
            yield pa.RecordBatch.from_arrays([docs.column("id").take(own), docs.column("th").take(own), pa.array(data, pa.binary())], ["id", "th", "hits"])

    dealt = matched.repartition(parts, "source").sortWithinPartitions("source")
    return dealt.mapInArrow(spread, f"id {id_type}, th long, hits binary")


def kept_digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def with_hits(rows: DataFrame, marks: DataFrame, parts: int, id_type: str, all_texts: bool) -> DataFrame:
    """All documents in order of id: uid (ascending with the id), id, n_words, kept_sha256 of those without hits, else hits and text (zstd)."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeezer = zstandard.ZstdCompressor(level=3)
        for b in T.slices(batches):
            data = pa.array([squeezer.compress(t.as_buffer()) for t in b.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), data, pa.nulls(b.num_rows, pa.binary())], ["id", "th", "z", "hits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, opener = TaskContext.get().partitionId() << 33, zstandard.ZstdDecompressor()
        last, marked = None, []
        for b in batches:
            out = []
            for key, th, z, hit in zip(*(b.column(c).to_pylist() for c in ("id", "th", "z", "hits")), strict=True):
                if (key, th) != last:
                    last, marked = (key, th), []
                if z is None:
                    marked.append(hit)
                    continue
                if marked:
                    out.append((uid, key, None, None, z, b"".join(marked)))
                else:
                    words = opener.decompress(z).split()  # ASCII white space, as everywhere here
                    out.append((uid, key, len(words), kept_digest(words), z if all_texts else None, None))
                uid += 1
            yield arrow(out, ["uid", "id", "n_words", "kept_sha256", "z", "hits"], [pa.int64(), b.schema.field("id").type, pa.int64(), pa.string(), pa.binary(), pa.binary()])

    texts = rows.mapInArrow(squeeze, f"id {id_type}, th long, z binary, hits binary")
    both = texts.unionByName(marks.withColumn("z", F.lit(None).cast("binary")))
    ranged = both.repartitionByRange(parts, F.asc_nulls_last("id"), "th").sortWithinPartitions(F.asc_nulls_last("id"), "th", F.col("z").isNotNull())
    return scratch.table(ranged.mapInArrow(merge, f"uid long, id {id_type}, n_words long, kept_sha256 string, z binary, hits binary"), "substring-hits")


def near_hits(hits_: np.ndarray, n: int) -> np.ndarray:
    """Starts of the windows of ``n`` words that hold a block-long hit."""
    if n < WINDOW:
        return np.zeros(0, np.int64)
    edge = np.zeros(n + 2, np.int64)
    hits_ = np.unique(hits_)
    np.add.at(edge, np.maximum(0, hits_ - (WINDOW - BLOCK)), 1)
    np.add.at(edge, hits_ + 1, -1)
    return np.flatnonzero(np.cumsum(edge[: n - WINDOW + 1]) > 0)


def candidates(marked: DataFrame, owners: int) -> DataFrame:
    """Windows near hits, packed by owner; a slice sends a window once, its further places in the slice go with its documents."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for b in ordered_slices(batches):
            texts = pa.array([opener.decompress(z) for z in b.column("z").to_pylist()], pa.binary()).cast(pa.string())
            values, bounds = word_hashes(texts)
            near = [near_hits(np.frombuffer(h, "<u4").astype(np.int64), n) + a
                    for h, n, a in zip(b.column("hits").to_pylist(), np.diff(bounds).tolist(), bounds[:-1].tolist(), strict=True)]
            at = np.concatenate([*near, np.zeros(0, np.int64)])
            hashes = np.stack([rolling(values[:, k], WINDOW, BASES[k])[at] if len(at) else np.zeros(0, np.uint64) for k in (0, 1)], 1)
            again = ~first_places(hashes)
            source = b.column("uid")[0].as_py()
            sent = hashes[~again]
            out = [(o, source, w, None, None, h, a, None) for o, w, _, _, h, a in
                   packed(sent[:, 1] % np.uint64(owners), at[~again], sent, np.zeros(len(sent), bool), owners)]
            docs = pa.RecordBatch.from_arrays([b.column("uid"), pa.array(bounds[:-1]), pa.array(np.diff(bounds))], ["uid", "first", "n"])
            out.append((source % owners, source, True, None, None, None, put(at[again], True), as_bytes(docs)))
            yield arrow(out, PACKED_NAMES, PACKED_TYPES)

    return marked.mapInArrow(send, PACKED)


def ordered_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices in which uid ascends within one range of ids, so that slices never overlap in order."""
    for b in batches:
        uid = b.column("uid").to_numpy()
        cuts = np.flatnonzero((np.diff(uid) < 0) | (np.diff(uid >> 33) != 0)) + 1
        for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(uid)], strict=True):
            sizes = np.cumsum([len(z) for z in b.column("z")[a:e].to_pylist()])
            start = 0
            while start < e - a:
                stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + T.SLICE_BYTES // 2, side="right")))
                yield b.slice(a + start, stop - start)
                start = stop


def repeats(sent: DataFrame, parts: int) -> DataFrame:
    """Places of windows that have an equal one earlier, by slice; rows of documents pass through."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "owner"):
            out = [(r["source"], True, r["at"], r["docs"]) for r in rows if r["docs"] is not None]
            rows = sorted((r for r in rows if r["docs"] is None), key=lambda r: r["source"])
            if rows:
                hashes = [np.frombuffer(r["hash"], np.uint64).reshape(-1, 2) for r in rows]
                later = ~first_places(np.concatenate(hashes))  # sources and places ascend
                ends = np.cumsum([len(h) for h in hashes]).tolist()
                for r, a, b in zip(rows, [0, *ends], ends, strict=False):
                    if later[a:b].any():
                        out.append((r["source"], True, put(got(r["at"], r["wide"])[later[a:b]], True), None))
            yield arrow(out, HIT_NAMES, HIT_TYPES)

    dealt = sent.repartition(parts, "owner").sortWithinPartitions("owner")
    return dealt.mapInArrow(settle, HITS)


def covered(repeated: DataFrame, parts: int) -> DataFrame:
    """uid and removed word places (as starts and ends) of each document with repeats."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "source"):
            docs = from_bytes(next(r["docs"] for r in rows if r["docs"] is not None))
            places = np.sort(np.concatenate([got(r["at"], True) for r in rows]))
            first, uid = docs.column("first").to_numpy(), docs.column("uid").to_numpy()
            of = np.searchsorted(first, places, side="right") - 1
            out = []
            for a, b in runs(of):
                p = places[a:b] - first[of[a]]
                gap = np.flatnonzero(np.diff(p) > WINDOW) + 1
                starts, ends = p[np.concatenate([[0], gap])], p[np.concatenate([gap - 1, [-1]])] + WINDOW
                out.append((int(uid[of[a]]), np.stack([starts, ends], 1).astype("<u4").tobytes()))
            yield arrow(out, ["uid", "removed"], [pa.int64(), pa.binary()])

    dealt = repeated.repartition(parts, "source").sortWithinPartitions("source")
    return scratch.table(dealt.mapInArrow(spread, "uid long, removed binary"), "substring-removed")


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Remove every word that a repeated window of WINDOW words covers: id, n_words, n_removed, kept_sha256.

    A window is repeated where its words also start earlier: in a document of smaller id (null ids come
    last; rows of equal id are ordered by a hash of their texts), or in the same one before it.  Null
    and empty texts have no words.  With ``with_text`` the kept words are returned too, as ``kept_text``.
    An empty table gives an empty result.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("th"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(scratch.partitions(df.sparkSession), math.ceil(total / TASK_BYTES))
    owners = max(parts, math.ceil(total / OWNED_BYTES))
    marks = scratch.table(per_document(hits(anchors(rows, owners), parts), parts, id_type), "substring-anchors")
    docs = with_hits(rows, marks, parts, id_type, with_text)
    marked = docs.filter("hits IS NOT NULL").select("uid", "id", "z", "hits")
    removed = covered(repeats(candidates(marked, owners), parts), parts)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for key, z, spans in zip(*(b.column(c).to_pylist() for c in ("id", "z", "removed")), strict=True):
                words = opener.decompress(z).split()  # ASCII white space, as everywhere here
                kept, at = [], 0
                for start, end in np.frombuffer(spans or b"", "<u4").reshape(-1, 2).tolist():
                    kept += words[at:start]
                    at = end
                kept += words[at:]
                out.append((key, len(words), len(words) - len(kept), kept_digest(kept), b" ".join(kept).decode() if with_text else None))
            yield arrow(out, ["id", "n_words", "n_removed", "kept_sha256", "kept_text"], [b.schema.field("id").type, pa.int64(), pa.int64(), pa.string(), pa.string()])

    result = f"id {id_type}, n_words long, n_removed long, kept_sha256 string, kept_text string"
    texts = (docs if with_text else marked).select("uid", "id", "z")
    cut = texts.join(removed.hint("shuffle_hash"), "uid", "left").mapInArrow(finish, result).withColumnRenamed("id", id_col)
    if with_text:
        return cut
    whole = docs.filter("hits IS NULL").select(F.col("id").alias(id_col), "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    return whole.unionByName(cut.drop("kept_text"))
