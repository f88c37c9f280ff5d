"""Lempel-Ziv phrase fingerprints: the phrases of a text's dictionary parse, as a minimum-hash signature."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from xxhash import xxh32_intdigest

from lumenframe.llm import scratch

#: Least phrase hashes that a signature keeps; the likeness has a standard error of about 0.5 / sqrt(SIGNATURE).
SIGNATURE = 128
#: Ranges of ids for each reducer, and how many there are at most.
RANGES, MOST_RANGES = 8, 1 << 14


def parse(data: bytes, at: int, seen: set[bytes], found: list[bytes]) -> int:
    """Parse ``data`` from ``at`` on into phrases: each is the shortest that isn't in ``seen`` yet.

    New phrases go to ``seen`` and ``found``.  Returns where the last, unfinished phrase starts (the end if
    there is none).  Every prefix of a phrase is a phrase, so a phrase's length is sought up or down
    from the length of the one before.
    """
    end, guess = len(data), 1
    while at < end:
        k = min(guess, end - at)
        phrase = data[at : at + k]
        if phrase in seen:
            while phrase in seen:
                k += 1
                if at + k > end:
                    return at
                phrase = data[at : at + k]
        else:
            while k > 1:
                shorter = data[at : at + k - 1]
                if shorter in seen:
                    break
                k, phrase = k - 1, shorter
        seen.add(phrase)
        found.append(phrase)
        at, guess = at + k, k
    return at


def least(hashes: np.ndarray, size: int = SIGNATURE) -> np.ndarray:
    """The ``size`` least distinct hashes, ascending."""
    if len(hashes) > 4 * size:
        hashes = hashes[hashes <= np.partition(hashes, 2 * size)[2 * size]]
        distinct = np.unique(hashes)
        return distinct[:size]
    return np.unique(hashes)[:size]


def hashed(phrases: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh32_intdigest, phrases), np.uint32, len(phrases))


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIGNATURE) -> float:
    """Estimated share of common phrases, 0 to 1; two empty signatures are alike, an empty and another aren't."""
    union = np.union1d(a, b)[:size]
    if not len(union):
        return 1.0
    return float(np.isin(union, np.intersect1d(a, b), assume_unique=True).sum() / len(union))


def encoded(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def fingerprint(text: str | None) -> str:
    """Fingerprint of one text: its signature's hashes, 8 hex digits each."""
    found: list[bytes] = []
    parse((text or "").encode("utf-8", "surrogatepass"), 0, set(), found)
    return encoded(least(hashed(found)))


class Parsed:
    """A text's signature, and its parse up to the last third, to go on from with another ending."""

    def __init__(self, text: str) -> None:
        self.text, self.third = text, len(text) // 3
        self.head = text[: len(text) - self.third].encode()
        self.phrases: list[bytes] = []
        seen: set[bytes] = set()
        self.at = parse(self.head, 0, seen, self.phrases)
        self.hashes = least(hashed(self.phrases))
        self.signature = self._ending(text[len(text) - self.third :], seen)

    def _ending(self, ending: str, seen: set[bytes]) -> np.ndarray:
        more: list[bytes] = []
        parse(self.head + ending.encode(), self.at, seen, more)
        return least(np.concatenate([self.hashes, hashed(more)]))

    def edited(self, following: str) -> tuple[str, np.ndarray]:
        """The edited text and its signature."""
        ending = following[: self.third]
        return self.text[: len(self.text) - self.third] + ending, self._ending(ending, set(self.phrases))


def range_of(value: Column, cuts: list, kind: str) -> Column:
    """How many of the ascending cuts are no greater than the value: first which run of cuts, then the place in the run."""
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts)) + 1
    runs = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    below = lambda held: F.size(F.filter(held, lambda c: c <= value))
    run = below(F.lit([r[0] for r in runs]).cast(f"array<{kind}>")) - 1
    within = below(F.get(F.array(*[F.lit(r).cast(f"array<{kind}>") for r in runs]), run))
    return F.when(run < 0, 0).otherwise(run * width + within)


def id_cuts(rows: DataFrame, ranges: int) -> list:
    """Ascending ids that cut the rows into about as many ranges: percentiles of numbers, and the least id of each range partition of others."""
    if isinstance(rows.schema["id"].dataType, NumericType):
        return sorted(set(rows.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []))
    dealt = rows.select("id").filter("id IS NOT NULL").repartitionByRange(ranges, "id").groupBy(F.spark_partition_id()).agg(F.min("id").alias("low"))
    return sorted(r.low for r in dealt.collect())[1:]  # a row for each range


def neighbour_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited form, a row for each document.

    The edited text has the last third of its code points replaced by as many from the start of the next
    document in descending order of id (after the last: the first).  Returns the id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  Null texts count as empty;
    an empty text has an empty fingerprint.  Rows of equal id are in the order of their texts, null ids come
    last.  A lone document is its own next.  An empty table gives an empty result.

    Texts are shuffled once, to ranges of ids; the first document of each range is also sent to the
    range before, whose last document needs it.
    """
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType.simpleString()
    parts = scratch.partitions(spark)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ranges = min(MOST_RANGES, RANGES * parts)
    cuts = id_cuts(rows, ranges)
    placed = rows.withColumn("bucket", F.when(F.col("id").isNull(), -1).otherwise(range_of(F.col("id"), cuts, id_type)))
    tops = sorted(placed.groupBy("bucket").agg(F.max("id").alias("top")).collect())  # a row for each range
    if not tops:
        return spark.createDataFrame([], f"{id_col} {id_type}, {RESULT}")
    edges = [(b, top, tops[(i + 1) % len(tops)][0]) for i, (b, top) in enumerate(tops)]
    edges = F.broadcast(spark.createDataFrame(edges, f"bucket int, top {id_type}, guest int"))  # at most MOST_RANGES + 1 rows
    placed = placed.join(edges, "bucket")
    guest = F.when(F.col("id").eqNullSafe(F.col("top")), F.col("guest"))
    copies = F.array_compact(F.array(
        F.struct(F.col("bucket").alias("to"), F.lit(False).alias("guest")),
        F.when(guest.isNotNull(), F.struct(guest.alias("to"), F.lit(True).alias("guest")))))
    sent = placed.select("id", "text", F.explode(copies).alias("c")).select("c.to", "c.guest", "id", "text")
    dealt = sent.repartition(parts, "to").sortWithinPartitions("to", "guest", F.desc_nulls_last("id"), "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, object, Parsed] | None = None
        for b in batches:
            out: list[tuple] = []
            for to, extra, key, text in zip(*(b.column(c).to_pylist() for c in ("to", "guest", "id", "text")), strict=True):
                if extra and (last is None or last[0] != to):
                    continue
                own = Parsed(text)
                if last is not None and last[0] == to:
                    was = last[2]
                    changed, signature = was.edited(text)
                    out.append((last[1], len(was.text), hashlib.sha256(changed.encode()).hexdigest(), encoded(was.signature), encoded(signature),
                                likeness(was.signature, signature), likeness(was.signature, own.signature)))
                last = None if extra else (to, key, own)
            types = [b.schema.field("id").type, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return dealt.mapInArrow(compare, f"{id_col} {id_type}, {RESULT}")


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
