"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.exact_dedup import exact_dedup
from lumenframe.llm.forest import near_duplicates
from lumenframe.llm.lzprint import neighbour_fingerprints
from lumenframe.llm.packing import pack
from lumenframe.llm.periodic import periodic_runs
from lumenframe.llm.pieces import round_trip
from lumenframe.llm.prefixtrie import prefix_trie
from lumenframe.llm.secrets import secret_scan
from lumenframe.llm.simhash import simhash_groups
from lumenframe.llm.substring import substring_dedup
from lumenframe.llm.tokenfile import token_files
from lumenframe.llm.toxicity import toxicity
from lumenframe.llm.urlfilter import host_of, url_filter


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents")).drop("chain")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(_read(spark, sf_dir, "documents"))


def op3_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_fingerprints(_read(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_read(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of ``pages``, made by rule as the tables have none.

    Hosts whose hash begins with 0, 1, 2 or 3 are added, two thirds of them removed 100 days later and half of those
    added again 60 days after; besides, one registered domain and two host paths in ten are listed.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host IS NOT NULL").distinct().withColumn("h", F.md5("host"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.conv(F.substring("h", 2, 2), 16, 10).cast("int"))
    listed = hosts.filter(F.substring("h", 1, 1).isin("0", "1", "2", "3")).select(F.col("host").alias("key"), "h", day.alias("day"))
    code = F.conv(F.substring("h", 4, 1), 16, 10).cast("int")
    first = listed.select("key", F.lit("add").alias("action"), F.col("day").alias("since"))
    gone = listed.filter(code < 10).select("key", F.lit("remove").alias("action"), F.date_add("day", 100).alias("since"))
    again = listed.filter(code < 5).select("key", F.lit("add").alias("action"), F.date_add("day", 160).alias("since"))
    paths = hosts.filter(F.substring("h", 5, 1).isin("0", "1", "2")).select(
        F.concat("host", F.lit("/"), F.element_at(F.array(F.lit("en"), F.lit("de")), F.when(F.substring("h", 6, 1) < "8", 1).otherwise(2))).alias("key"),
        F.lit("add").alias("action"), day.alias("since"))
    domain = pages.sparkSession.sql("SELECT 'example.org' AS key, a.* FROM VALUES ('add', DATE'2024-03-01'), ('remove', DATE'2024-03-15') AS a(action, since)")
    return first.unionByName(gone).unionByName(again).unionByName(paths).unionByName(domain)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no fetch time: page_id modulo 366 is the day of 2024."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int"))
    out = url_filter(pages.withColumn("fetched", fetched), dated_entries(pages))
    return out.withColumns({c: F.col(c).cast("string") for c in ("fetched", "listed_since")})


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_read(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation takes over the first crc32(id) % 6 turns of the first one of its hundred."""
    lent = F.crc32(F.col("c").cast("string")) % 6
    return prefix_trie(_read(spark, sf_dir, "conversations"), lent=lent, lender=F.col("c") - F.col("c") % 100)


def planted_cycle(doc_id: object, n: int) -> tuple[int, int] | None:
    """First word and period of the cycle in a document of ``n`` words: in each tenth by the hash of its id, none without an id."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs come by start, then period, so of equal exponents the first stays; exponents are compared as products."""
    found = periodic_runs(_read(spark, sf_dir, "documents"), cycle=planted_cycle)
    best = F.expr("reduce(runs, CAST(NULL AS struct<start:bigint,length:bigint,period:bigint>), (b, r) -> IF(b IS NULL OR r.length * b.period > b.length * r.period, r, b))")
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (SELECT text_sha256, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id) AS keep_id FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN k USING (text_sha256)
"""

#: A kind's matches lie between the pieces of the text split at them, so their places are sums of lengths.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS repo FROM documents),
r AS (
  SELECT doc_id, repo, kind, regexp_extract_all(t, re) AS m, regexp_extract_all(t, re, part) AS v, regexp_split_to_array(t, re) AS g FROM d, (VALUES
    (0, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), (1, 'AKIA[A-Z0-9]+', 0), (2, '[0-9a-f]{32,}', 0), (3, '[A-Za-z0-9+/_-]{20,}', 0)) k(kind, re, part)),
s AS (SELECT doc_id, repo, kind, m[i] AS m, v[i] AS v, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM r)),
e AS (SELECT doc_id, repo, kind, CAST(a AS BIGINT) AS a, CAST(a AS BIGINT) + length(m) AS z, v FROM s WHERE CASE kind WHEN 0 THEN length(v) >= 8 WHEN 1 THEN length(v) >= 16 ELSE true END),
b AS (SELECT * FROM e WHERE kind < 3),
h AS (SELECT *, list_sum(list_transform(map_values(list_histogram(string_split(v, ''))), lambda n: -(n / length(v)::DOUBLE) * log2(n / length(v)::DOUBLE))) AS bits FROM e WHERE kind = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')),
l AS (SELECT doc_id, repo, kind, a, z, v FROM h WHERE bits >= 3.5 AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = h.doc_id AND b.a < h.z AND h.a < b.z)),
c AS (SELECT * FROM b UNION ALL SELECT * FROM l),
o AS (SELECT v, count(DISTINCT repo) <= 2 AND count(DISTINCT string_split(repo, '/')[1]) <= 1 AS live FROM c GROUP BY v),
x AS (SELECT c.*, live, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || a || ':' || z AS span FROM c JOIN o USING (v)),
y AS (SELECT doc_id, count_if(kind = 0)::BIGINT AS n_assign, count_if(kind = 1)::BIGINT AS n_access, count_if(kind = 2)::BIGINT AS n_hex, string_agg(span, ',' ORDER BY a, kind) FILTER (kind < 3) AS base,
      string_agg(span, ',' ORDER BY a, kind) FILTER (kind < 3 OR live) AS spans, count_if(live)::BIGINT AS n_live, count_if(NOT live)::BIGINT AS n_example FROM x GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN y USING (doc_id)
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS at FROM d),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS nth FROM win) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS at FROM again),
kept AS (SELECT p.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p.at) AS t FROM p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.at = p.at WHERE g.at IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

OP8_SQL = r"""
WITH p AS (
  SELECT page_id, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched,
         nullif(regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':\d*$', '')), '\.$', ''), '') AS host,
         regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages),
k AS (
  SELECT page_id, fetched, host, string_split(host, '.') AS l, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM p WHERE host IS NOT NULL),
asked AS (
  SELECT DISTINCT page_id, fetched, unnest(list_concat(
    list_transform(range(1, len(l) + 1), lambda i: array_to_string(l[i:], '.')),
    list_transform(range(1, len(s) + 1), lambda i: host || '/' || array_to_string(s[1:i], '/')))) AS key
  FROM k),
h AS (SELECT host, md5(host) AS h, DATE '2024-01-01' + CAST(('0x' || substr(md5(host), 2, 2))::INTEGER AS INTEGER) AS day FROM (SELECT DISTINCT host FROM p WHERE host IS NOT NULL)),
c AS (SELECT *, ('0x' || substr(h, 4, 1))::INTEGER AS code FROM h WHERE substr(h, 1, 1) IN ('0', '1', '2', '3')),
e AS (
  SELECT host AS key, true AS "on", day AS since FROM c
  UNION ALL SELECT host, false, day + 100 FROM c WHERE code < 10
  UNION ALL SELECT host, true, day + 160 FROM c WHERE code < 5
  UNION ALL SELECT host || '/' || CASE WHEN substr(h, 6, 1) < '8' THEN 'en' ELSE 'de' END, true, day FROM h WHERE substr(h, 5, 1) IN ('0', '1', '2')
  UNION ALL VALUES ('example.org', true, DATE '2024-03-01'), ('example.org', false, DATE '2024-03-15')),
g AS (SELECT key, since, bool_or("on") AS "on" FROM e GROUP BY ALL),
n AS (SELECT *, lag("on") OVER (PARTITION BY key ORDER BY since) AS was FROM g),
i AS (SELECT key, since, "on", lead(since) OVER (PARTITION BY key ORDER BY since) AS until FROM n WHERE was IS DISTINCT FROM "on"),
m AS (
  SELECT page_id, count(*) AS n_active, max(struct_pack(n := length(key), key := key, since := since)) AS m
  FROM asked JOIN i USING (key) WHERE "on" AND since <= fetched AND (until IS NULL OR fetched < until) GROUP BY page_id)
SELECT page_id, host, CAST(fetched AS VARCHAR) AS fetched, n_active IS NOT NULL AS blocked, coalesce(n_active, 0) AS n_active,
       m.m.key AS matched_key, CAST(m.m.since AS VARCHAR) AS listed_since
FROM p LEFT JOIN m USING (page_id)
"""

#: CRC-32 by its table; a conversation is its turns written one after the other, each with its lengths.
OP11_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS r,
         length(coalesce(role, '')) || ':' || coalesce(role, '') || length(coalesce(text, '')) || ':' || coalesce(text, '') AS x, length(coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
bits(i, k, v) AS (SELECT i, 0, i::UBIGINT FROM range(256) b(i) UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END FROM bits WHERE k < 8),
crc(c, s, v) AS (
  SELECT DISTINCT c, c::VARCHAR, 4294967295::UBIGINT FROM t
  UNION ALL SELECT c, s[2:], xor(crc.v // 256, b.v) FROM crc, (SELECT i, v FROM bits WHERE k = 8) b WHERE s <> '' AND b.i = xor(crc.v % 256, ascii(s)::UBIGINT)),
h AS (SELECT c, xor(v, 4294967295::UBIGINT) % 6 AS h FROM crc WHERE s = ''),
m AS (SELECT h.c, r AS o, x, n FROM h JOIN t ON t.c = h.c - h.c % 100 AND r < h UNION ALL SELECT c, 100 + r, x, n FROM t JOIN h USING (c) WHERE r >= h),
p AS (SELECT c, row_number() OVER w AS d, n, sha256(string_agg(x, '') OVER w) AS k, count(*) OVER (PARTITION BY c) AS l FROM m WINDOW w AS (PARTITION BY c ORDER BY o)),
every AS (SELECT c, d, n, k, lag(k, 1, '') OVER (PARTITION BY c ORDER BY d) AS up, l FROM p UNION ALL SELECT h.c, 0, 0, '', NULL, coalesce(l, 0) FROM h LEFT JOIN (SELECT c, max(l) AS l FROM p GROUP BY c) USING (c)),
node AS (SELECT k, d AS depth, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = l), '') AS ends FROM every GROUP BY k, d),
kids AS (SELECT up AS k, count(*) AS kids FROM node WHERE depth > 0 GROUP BY up),
full_ AS (SELECT node.*, coalesce(kids, 0) AS kids FROM node LEFT JOIN kids USING (k)),
below AS (SELECT a.k, sum((f.n_convs - 1) * f.n) AS saved, count_if(f.kids = 0) AS leaves FROM full_ f JOIN every e ON e.c = f.conv_id AND e.d = f.depth JOIN every a ON a.c = e.c AND a.d <= e.d GROUP BY a.k)
SELECT f.conv_id, f.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.kids::BIGINT AS n_children, b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ f JOIN below b USING (k) LEFT JOIN node u ON f.depth > 0 AND u.k = f.up
"""

#: Equal words at a distance p, islands of them, and the least period of each stretch.
OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
bits(i, k, v) AS (SELECT i, 0, i::UBIGINT FROM range(256) b(i) UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END FROM bits WHERE k < 8),
crc(doc_id, s, v) AS (
  SELECT DISTINCT doc_id, doc_id::VARCHAR, 4294967295::UBIGINT FROM d
  UNION ALL SELECT doc_id, s[2:], xor(crc.v // 256, b.v) FROM crc, (SELECT i, v FROM bits WHERE k = 8) b WHERE s <> '' AND b.i = xor(crc.v % 256, ascii(s)::UBIGINT)),
h AS (SELECT doc_id, xor(v, 4294967295::UBIGINT)::BIGINT AS h FROM crc WHERE s = ''),
g AS (SELECT doc_id, w, len(w) AS n, h, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS e FROM d JOIN h USING (doc_id)),
x AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS i, w, h, n, a, 1 + (n - a) // e AS p FROM g),
v AS (SELECT doc_id, i, n, w[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM x),
pair AS (SELECT a.doc_id, b.i - a.i AS p, a.i AS i FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND b.i - a.i <= a.n // 4),
often AS (SELECT doc_id, p, i FROM pair QUALIFY count(*) OVER (PARTITION BY doc_id, p) >= greatest(6 - p, 3 * p)),
isle AS (SELECT doc_id, p, min(i) AS s, count(*) + p AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS z FROM often) GROUP BY doc_id, p, z),
run AS (SELECT doc_id, s, l, min(p) AS p FROM isle WHERE l >= greatest(6, 4 * p) GROUP BY doc_id, s, l),
best AS (SELECT * FROM run r WHERE NOT EXISTS (SELECT 1 FROM run o WHERE o.doc_id = r.doc_id AND (o.l * r.p > r.l * o.p OR o.l * r.p = r.l * o.p AND (o.s < r.s OR o.s = r.s AND o.p < r.p)))),
total AS (SELECT doc_id, count(*) AS n, string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p) AS t FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + p, s + l)) AS i FROM run),
kept AS (SELECT v.doc_id, string_agg(word, ' ' ORDER BY v.i) AS t FROM v LEFT JOIN gone g ON g.doc_id = v.doc_id AND g.i = v.i WHERE g.i IS NULL GROUP BY v.doc_id)
SELECT d.doc_id, coalesce(total.n, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, 1000 * best.l // best.p AS exponent_milli,
       sha256(coalesce(total.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN total USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: Similar sets share one of their rarest fifth (and one more) of shingles, so pairs come from those; each is counted in full.
OP13_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
r AS (SELECT doc_id, g, uses FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY uses, g) AS nth FROM (SELECT *, count(*) OVER (PARTITION BY g) AS uses FROM e)) JOIN n USING (doc_id) WHERE nth <= n - ceil(n * 0.8) + 1),
p AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id WHERE a.uses > 1),
m AS (SELECT p.a, p.b, count(*) AS shared FROM p JOIN e x ON x.doc_id = p.a JOIN e y ON y.doc_id = p.b AND y.g = x.g GROUP BY p.a, p.b),
l AS (SELECT a, b FROM m JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT a, b FROM u UNION SELECT reach.a, u.b FROM reach JOIN u ON u.a = reach.b),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id <= coalesce(b, doc_id) AS kept FROM n LEFT JOIN low ON a = doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_lz_fingerprints": op3_lz_fingerprints,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_token_files": op5_token_files,
    "op6_toxicity": op6_toxicity,
    "op7_packing": op7_packing,
    "op8_url_filter": op8_url_filter,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_simhash": op10_simhash,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_lsh_forest": op13_lsh_forest,
}
ORACLE_SQL: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op2_secret_scan": OP2_SQL, "op4_substring_dedup": OP4_SQL, "op8_url_filter": OP8_SQL, "op11_prefix_trie": OP11_SQL, "op12_periodic_runs": OP12_SQL, "op13_lsh_forest": OP13_SQL}
