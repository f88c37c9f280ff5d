"""Secret scans: pattern matches, and who in the corpus owns each candidate value."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from xxhash import xxh64_intdigest

from lumenframe.llm import scratch
from lumenframe.llm import text as T
from lumenframe.llm.skew import join_hot

# Fixed patterns of the three base kinds, in their order.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "owned")
#: Longer tokens of letters and digits, candidates by their ownership alone.
LOOSE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
#: Quick tests of a whole slice; they let through everything that the patterns above match.
HINTS = (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", r"AKIA[A-Z0-9]{12}", r"[0-9a-f]{32}", r"[A-Za-z0-9+/_-]{20}")
#: Bits a character that a loose candidate has at least.
LEAST_ENTROPY = 3.5
#: Owners and repositories that a live-looking credential has at most; beyond, it is a copied example.
MOST_OWNERS = 1
MOST_REPOSITORIES = 2

#: What a masked span becomes.
MASK = "<secret>"

FOUND = ("n_assign long, n_access long, n_hex long, base_sha256 string, "
         "base array<struct<at:int,kind:int,end:int,hash:long>>, loose array<struct<at:int,kind:int,end:int,hash:long>>")


def entropy(value: str) -> float:
    counts = Counter(value).values()
    return -sum(n / len(value) * math.log2(n / len(value)) for n in counts)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, secret value) of the base kinds, by start, then kind."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def loose_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Tokens with both letters and digits and much entropy that touch no base span."""
    found, at, covered = [], 0, 0  # covered: where the base spans that start before a token end
    for m in LOOSE.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            covered, at = max(covered, base[at][2]), at + 1
        value = m[0]
        if covered <= m.start() and re.search("[0-9]", value) and re.search("[A-Za-z]", value) and entropy(value) >= LEAST_ENTROPY:
            found.append((m.start(), 3, m.end(), value))
    return found


def joined(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


def candidates(df: DataFrame) -> DataFrame:
    """The matches of each row of ``df`` (id, th, text, repo), whole texts, with 64-bit hashes of their values."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("at", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("hash", pa.int64())]))
        empty = hashlib.sha256(b"").hexdigest()
        for b in T.slices(batches):
            texts = b.column("text")
            likely = [pc.match_substring_regex(texts, h).to_pylist() for h in HINTS]
            counts, digests, bases, looses = ([], [], []), [], [], []
            for i, (any_base, loose) in enumerate(zip(zip(*likely[:3], strict=True), likely[3], strict=True)):
                found, more = [], []
                if any(any_base) or loose:
                    text = texts[i].as_py()
                    found = base_spans(text) if any(any_base) else []
                    more = loose_spans(text, found) if loose else []
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in found))
                digests.append(hashlib.sha256(joined(found).encode()).hexdigest() if found else empty)
                for spans, out in ((found, bases), (more, looses)):
                    out.append([(a, k, e, xxh64_intdigest(v.encode()) - (1 << 63)) for a, k, e, v in spans])
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("th"), b.column("repo"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()),
                 *[pa.array([[dict(zip(("at", "kind", "end", "hash"), s, strict=True)) for s in spans] for spans in out], span) for out in (bases, looses)]],
                ["id", "th", "repo", "n_assign", "n_access", "n_hex", "base_sha256", "base", "loose"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.mapInArrow(scan, f"id {kinds['id']}, th long, repo string, {FOUND}")


def ownership(found: DataFrame) -> DataFrame:
    """Distinct repositories and owners of each candidate hash: hash, uses, repositories, owners.

    ``found`` has hash, repo.  The owner is the part of the repository before a slash, or all of it; a
    candidate without a repository counts as one unknown repository.
    """
    pairs = found.groupBy("hash", F.coalesce("repo", F.lit("")).alias("repo")).agg(F.count("*").alias("uses"))
    pairs = pairs.withColumn("owner", F.substring_index("repo", "/", 1))
    return pairs.groupBy("hash").agg(F.sum("uses").alias("uses"), F.countDistinct("repo").alias("repositories"), F.countDistinct("owner").alias("owners"))


def scanned_rows(df: DataFrame, id_col: str, text_col: str, repo_col: str) -> DataFrame:
    """The result of ``secret_scan`` with ``id`` and ``th`` (a hash of the text)."""
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.col(text_col).cast("string").alias("text"), F.col(repo_col).cast("string").alias("repo"))
    scanned = scratch.table(candidates(rows).withColumn("uid", F.monotonically_increasing_id()), "secrets")
    each = scanned.select("uid", "repo", F.explode(F.concat("base", "loose")).alias("s")).select("uid", "repo", "s.*")
    owned = scratch.table(ownership(each), "secret-owners")
    known = join_hot(each.drop("repo"), owned, "hash", "uses", "uid")
    live = (F.col("owners") <= MOST_OWNERS) & (F.col("repositories") <= MOST_REPOSITORIES)
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    shown = F.when((F.col("kind") < 3) | live, F.struct("at", "kind", F.concat_ws(":", name, "at", "end").alias("span")))
    of_row = known.groupBy("uid").agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(shown)), lambda s: s["span"])).alias("spans"),
        F.count_if(live).alias("n_live"), F.count_if(~live).alias("n_example"))
    out = scanned.drop("base", "loose", "repo").join(of_row, "uid", "left")
    return out.select("id", "th", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"),
                      F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source") -> DataFrame:
    """Secrets of every row of ``df``: one row each, with the digest columns and ``spans``.

    Base kinds are assign, access and hex.  Loose tokens become spans of kind ``owned`` where the
    corpus says that they are one owner's (at most MOST_OWNERS owners and MOST_REPOSITORIES repositories);
    tokens that others copy are examples and add nothing.  Base matches always stay; ``n_live``
    and ``n_example`` count base and loose candidates by the same test.  Null texts count as empty,
    rows that repeat an id are rows of their own, an empty table gives an empty result.
    """
    return scanned_rows(df, id_col, text_col, repo_col).drop("th").withColumnRenamed("id", id_col)


def masked(text: str, spans: str) -> str:
    """The text with each run of overlapping spans replaced by MASK."""
    out, at = [], 0
    for start, end in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",") if s):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", length_col: str | None = "n_chars") -> DataFrame:
    """``df`` with every span of ``secret_scan`` masked in its text, and the length in code points set anew.

    All rows and columns stay; texts without a span are as they were, null texts too.  A length column that doesn't hold whole numbers is
    another thing and stays.
    """
    found = scanned_rows(df, id_col, text_col, repo_col).filter("spans <> ''").groupBy("id", "th").agg(F.first("spans").alias("spans"))
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    plain = df.toDF(*names.values())
    text = F.col(names[text_col]).cast("string")
    same = plain[names[id_col]].eqNullSafe(found["id"]) & (F.xxhash64(text) == found["th"])
    joined_ = plain.join(found, same, "left").drop("id", "th")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column("spans")
            texts = b.column(names[text_col])
            if spans.null_count < b.num_rows:
                texts = pa.array([t if s is None or t is None else masked(t, s) for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], texts.type)
            yield pa.RecordBatch.from_arrays([texts if n == names[text_col] else b.column(n) for n in names.values()], list(names.values()))

    out = joined_.mapInArrow(mask, plain.schema)
    if length_col in names and isinstance(kind := plain.schema[own := names[length_col]].dataType, IntegralType):
        out = out.withColumn(own, F.when(text.isNull(), F.col(own)).otherwise(F.char_length(text)).cast(kind))
    return out.toDF(*df.columns)
