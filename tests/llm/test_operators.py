"""The ten operators against plain versions, on odd rows, and on empty tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest, xxh64_intdigest

from lumenframe.llm import lzprint, packing, pieces, scratch, secrets, simhash, substring, tokenfile, tokens, toxicity, urlfilter
from lumenframe.llm.exact_dedup import directory, drop_copies, exact_dedup, routed
from tests.llm.common import DOCS, WORD, clashing, odd_rows, random_docs


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


ALL = {
    "exact": lambda s, d: exact_dedup(d), "secrets": lambda s, d: secrets.secret_scan(d), "lz": lambda s, d: lzprint.neighbour_fingerprints(d), "substring": lambda s, d: substring.substring_dedup(d),
    "tokens": lambda s, d: tokenfile.token_files(d), "toxicity": lambda s, d: toxicity.toxicity(d, labels_of(s, [(1, 1, 0), (3, 1, 1), (4, None, None)])), "pieces": lambda s, d: pieces.round_trip(d),
    "simhash": lambda s, d: simhash.simhash_groups(d), "urls": lambda s, d: urlfilter.url_filter(d.withColumn("f", F.lit("2024-01-05")), s.createDataFrame([], "key string, action string, since date"), "doc_id", "text", "f"),
}


@pytest.mark.parametrize("name", ALL)
def test_one_row_for_each_document(spark, odd, name):
    got = ALL[name](spark, clashing(odd)).select("doc_id").collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in odd_rows())


@pytest.mark.parametrize("name", [*ALL, "packing"])
def test_empty_tables(spark, none, name):
    assert (packing.pack(none) if name == "packing" else ALL[name](spark, none)).count() == 0


def test_exact_dedup(spark, odd):
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for r in odd_rows():
        groups[bare(r[1])].append((-len(r[1] or ""), r[0] is None, r[0] or 0))
    got = exact_dedup(odd, capacity=3).collect()
    for r in got:
        assert r.group_size == next(len(g) for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
    assert sum(r.kept for r in got) == len(groups)
    for t, g in groups.items():
        _, no_id, keep = min(g)
        assert {r.keep_id for r in got if r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()} == {None if no_id else keep}
    assert drop_copies(clashing(odd)).count() == len(groups)


@pytest.mark.parametrize("shift", [0, 20, 40])
def test_directory_splits_overfull_buckets(spark, shift):
    """Keys that share their first ``shift`` bits fill few slots, whose buckets are split below the slots."""
    keys = spark.range(2000).select(F.shiftrightunsigned(F.xxhash64("id"), shift).alias("key"))
    found = directory(keys, 20, 100)
    rows = routed(keys, found).groupBy("bucket", "owner").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
    unsigned = lambda x: x % (1 << 64)
    assert sum(r.n for r in rows) == 2000 and max(r.n for r in rows) <= 100 and len(rows) == len({r.bucket for r in rows}) > 16
    rows.sort(key=lambda r: unsigned(r.bucket))
    assert [r.owner for r in rows] == sorted(r.owner for r in rows) and len({r.owner for r in rows}) in (range(10, 21) if not shift else range(1, 21))
    assert len({r.bucket for r in routed(keys, directory(keys, 20, 10_000)).select("bucket").distinct().collect()}) == 1


def test_another_directory_gives_other_routes_and_the_same_rows(spark):
    rows = [(i, f"text {i % 150}", "en", "s", None) for i in range(400)]
    df = spark.createDataFrame(rows, DOCS)
    few, many = (sorted(exact_dedup(df, capacity=c).collect(), key=str) for c in (1000, 2))
    assert few == many and sum(r.kept for r in few) == 150
    keys = df.select(F.xxhash64("text").alias("key")).distinct()
    routes = [{(r.bucket, r.owner) for r in routed(keys, directory(keys, 8, c)).collect()} for c in (1000, 2)]
    assert len(routes[0]) == 1 and len(routes[1]) > 70


def test_hot_texts_are_merged_under_salts(spark, monkeypatch):
    monkeypatch.setattr("lumenframe.llm.exact_dedup.LEAST_HOT", 10)
    rows = [(i if i % 3 else None, "the same" if i % 3 < 2 else f"text {i}", "en", "s", None) for i in range(300)]
    got = exact_dedup(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    same = [r for r in got if r.group_size > 1]
    assert len(same) == 200 and {r.group_size for r in same} == {200} and {r.keep_id for r in same} == {1} and sum(r.kept for r in got) == 101


def test_secret_base_kinds(spark, odd):
    got = {r.doc_id: r for r in secrets.secret_scan(odd).collect() if r.doc_id is not None}
    text = odd_rows()[13][1]
    assert got[13].spans.split(",")[:3] == [f"assign:0:{text.index(' AKIA') - 1}", f"access:{text.index('AKIA')}:{text.index('AKIA') + 20}", f"hex:{len(text) - 32}:{len(text)}"]
    assert got[13].base_sha256 == hashlib.sha256(got[13].spans.encode()).hexdigest() and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_short_assignments_use_up_their_text():
    assert secrets.base_spans("token: token: abcdefghij") == []
    assert [s[:3] for s in secrets.base_spans("x API_KEY=abcdefgh1")] == [(2, 0, 19)]
    assert secrets.base_spans("ſecret=abcdefgh1") == []


def test_repositories_of_one_owner_make_an_example_too(spark):
    few, many = "Zk93hQpL72mXvB10sTqW", "Ab12Cd34Ef56Gh78Ij90"
    rows = [(i, f"see {many} ok", None, f"one/r{i}", None) for i in range(3)] + [(5 + i, f"see {few} ok", None, f"two/r{i}", None) for i in range(2)]
    got = {r.doc_id: r for r in secrets.secret_scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i].spans == "" and got[i].n_example == 1 for i in range(3)) and all(got[i].spans == "owned:4:24" and got[i].n_live == 1 for i in (5, 6))


def test_loose_tokens_touch_no_base_span():
    text = " ".join(f"token=abcdefgh{i}Xy9 Zk93hQpL72mXvB10s{i:03d} AKIA{'B' * 16}/Zk93hQpL72mXv{i:04d}" for i in range(300))
    base = secrets.base_spans(text)
    plain = [(m.start(), 3, m.end(), m[0]) for m in secrets.LOOSE.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and secrets.entropy(m[0]) >= secrets.LEAST_ENTROPY
             and not any(a < m.end() and m.start() < b for a, _, b, _ in base)]
    assert secrets.loose_spans(text, base) == plain and len(plain) == 300


def test_ownership_tells_examples_from_live_keys(spark):
    live, example = "Zk93hQpL72mXvB10sTqW", "Ab12Cd34Ef56Gh78Ij90"
    rows = [(i, f"see {example} ok", None, f"owner{i}/r", None) for i in range(4)] + [(9, f"my {live}", None, "owner9/r", None)]
    got = {r.doc_id: r for r in secrets.secret_scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[9].spans == "owned:3:23" and got[9].n_live == 1 and all(got[i].spans == "" and got[i].n_example == 1 for i in range(4))


def test_masking_keeps_rows_and_columns(spark, odd):
    out = secrets.mask_secrets(clashing(odd))
    assert out.columns == clashing(odd).columns and out.count() == odd.count()
    row = out.filter("doc_id = 13").first()
    assert row.text == f"{secrets.MASK}\" {secrets.MASK} {secrets.MASK}" and row.n_chars == len(row.text)
    assert out.filter("doc_id = 0").first().text is None


def test_lz_parse():
    found = []
    assert lzprint.parse(b"aababcabcd", 0, set(), found) == 10 and found == [b"a", b"ab", b"abc", b"abcd"]
    seen, more = set(), []
    at = lzprint.parse(b"aabab", 0, seen, more)
    lzprint.parse(b"aababcabcd", at, seen, more)
    assert more == found


def plain_phrases(data):
    """The phrases of an LZ78 parse, a trie walk for each."""
    trie, found, at = {}, set(), 0
    while at < len(data):
        node, start = trie, at
        while at < len(data) and data[at] in node:
            node, at = node[data[at]], at + 1
        if at == len(data):
            break
        node[data[at]] = {}
        at += 1
        found.add(data[start:at])
    return found


def plain_signature(text):
    return sorted({xxh32_intdigest(p) for p in plain_phrases(text.encode())})[: lzprint.SIGNATURE]


def plain_likeness(a, b):
    union = sorted({*a, *b})[: lzprint.SIGNATURE]
    return sum(x in a and x in b for x in union) / len(union) if union else 1.0


def test_lz_likeness_equals_a_plain_version(spark):
    rows = [r for r in odd_rows() if r[0] is not None][:14] + [(100 + i, t, None, None, None) for i, (_, t, *_) in enumerate(random_docs(6, 60))]
    got = {r.doc_id: r for r in lzprint.neighbour_fingerprints(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    between = 0
    for r, nxt in zip(order, [*order[1:], order[0]], strict=True):
        t, x = r[1] or "", nxt[1] or ""
        k = len(t) // 3
        own, edited, other = (set(plain_signature(v)) for v in (t, t[: len(t) - k] + x[:k], x))
        g = got[r[0]]
        assert g.fingerprint == "".join(f"{h:08x}" for h in sorted(own)) and g.edited_fingerprint == "".join(f"{h:08x}" for h in sorted(edited))
        assert (g.near_edited, g.near_next) == pytest.approx((plain_likeness(own, edited), plain_likeness(own, other)), abs=1e-12)
        between += 0 < g.near_next < 1
    assert between > 20


@pytest.mark.parametrize("n", [0, 1, 7, 200])
def test_ranges_of_ids(spark, n):
    cuts = [3 * i for i in range(n)]
    got = spark.range(-2, 3 * n + 2).select("id", lzprint.range_of(F.col("id"), cuts, "bigint").alias("r")).collect()
    assert all(r.r == sum(c <= r.id for c in cuts) for r in got)


def test_lz_neighbours(spark):
    rows = [r for r in odd_rows() if r[0] is not None][:14] + [(100 + i, t, None, None, None) for i, (_, t, *_) in enumerate(random_docs(5, 40))]
    got = {r.doc_id: r for r in lzprint.neighbour_fingerprints(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for r, nxt in zip(order, [*order[1:], order[0]], strict=True):
        t, x = r[1] or "", nxt[1] or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + x[:k]
        g = got[r[0]]
        assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert g.fingerprint == lzprint.fingerprint(t) and g.edited_fingerprint == lzprint.fingerprint(edited)
        assert 0 <= g.near_next <= 1 and (t != edited or g.near_edited == 1)
    assert got[9].near_edited > 0.4 > got[9].near_next


def brute_substrings(docs):
    seen, out = set(), {}
    for i, t in sorted(docs):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest(), " ".join(kept))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    docs = random_docs(seed)
    want = brute_substrings([r[:2] for r in docs])
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_dedup(df).collect()} == {k: v[:3] for k, v in want.items()}
    assert sum(v[1] for v in want.values()) > 500
    assert {r.doc_id: r.kept_text for r in substring.substring_dedup(df, with_text=True).collect()} == {k: v[3] for k, v in want.items()}


def test_places_pack_both_ways():
    for places in ([0, 5, 70000], [3], []):
        a = np.array(places, np.int64)
        assert substring.got(substring.put(a, True), True).tolist() == places
    assert substring.got(substring.put(np.array([7, 300, 65000]), False), False).tolist() == [7, 300, 65000]


def encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_encoder_equals_the_library():
    texts = [r[1] or "" for r in odd_rows()] + ["É̀x Straße, ÀÉ.! don't I'm x1y2 áb  z ΣΑΣ İi <|startoftext|>x", "A,B", "...", "ÿ."]
    ids, bounds = tokens.Encoder.of(tokens.default_tokenizer()).ids(pa.array(texts), None)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == encoded(texts)


def test_known_ids_take_little_room():
    import gc
    import tracemalloc

    rng = np.random.default_rng(1)
    letters = rng.integers(97, 123, (40, 2000, 9), np.uint8)
    slices = [pa.array([" ".join(w.tobytes().decode() for w in s)]) for s in letters]
    encoder = tokens.Encoder(tokens.default_tokenizer())
    encoder.ids(slices[0], None)
    gc.collect()
    arrow = pa.total_allocated_bytes()
    tracemalloc.start()
    for s in slices[1:]:
        encoder.ids(s, None)
    gc.collect()
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert held < 80 * 39 * 2000
    assert encoder.ids(slices[3], None)[0].tolist() == encoded(slices[3].to_pylist())[0]


def test_known_ids_start_anew_and_leave_long_texts_out():
    asked = []

    def made(new):
        asked.append(new)
        return [np.full(len(v), ord(v[-1:] or "x"), "<u4").tobytes() for v in new]

    known = tokens.KnownIds(most=400, longest=5)
    for i in range(1, 100):
        values = [f"v{i}", "too long for it", "", "v0", f"é{i}"]
        ids, n = known.parts(pa.array(values), made)
        assert n.tolist() == [len(v) for v in values] and ids.tolist() == [ord(v[-1]) for v in values for _ in v]
        assert known.held < 600
    assert all("too long for it" in new for new in asked) and 2 < sum("v0" in new for new in asked) < 60
    assert known.parts(pa.array([], pa.string()), made)[0].tolist() == []


def test_token_files(spark, odd):
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfile.token_files(odd).collect())
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at = 0
    for (start, doc_id, n, crc), r, ids in zip(got, rows, encoded([r[1] for r in rows]), strict=True):
        assert (start, doc_id, n, crc) == (at, r[0], len(ids) + 1, zlib.crc32(np.array([*ids, 1], "<u4").tobytes()))
        at += n


def test_sequences_are_read_in_place(spark, odd):
    folder = scratch.new_path(spark, "t")
    index = tokenfile.write_tokens(odd, folder)
    row = index.orderBy(F.desc("n_tokens")).first()
    file = tokenfile.SequenceFile(row.file)
    ids, mask = file.sequence(row.start // tokenfile.LENGTH)
    assert len(ids) == tokenfile.LENGTH and ids[row.start % tokenfile.LENGTH] == file.ids(row.start, 1)[0] and mask[row.start % tokenfile.LENGTH]
    assert pa.ipc.open_file(file.source).schema.field("ids").type == pa.list_(pa.uint16(), tokenfile.LENGTH)


def test_best_fit_takes_the_tightest_window():
    fit = packing.BestFit(10)
    assert [fit.place(n) for n in (7, 6, 4, 3, 3, 2)] == [(0, 0), (1, 0), (1, 6), (0, 7), (2, 0), (2, 3)]


def plain_best_fit(lengths, window):
    """Rests in decreasing length into the window with the least room: the room that each window has in the end."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if not fits:
            rooms.append(window)
            fits = [len(rooms) - 1]
        rooms[min(fits, key=lambda i: rooms[i])] -= n
    return sorted(rooms)


def test_packing_a_table_equals_plain_best_fit(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["a", "word", "of", "many"], rng.integers(0, 200))), "en", "s", None) for i in range(300)]
    got = packing.pack(clashing(spark.createDataFrame(rows, DOCS).repartition(4)), window=64).collect()
    used = collections.Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert sorted(64 - n for n in used.values()) == plain_best_fit([r.length for r in got], 64)
    assert all(r.length == min(64, r.doc_tokens - r.start) and r.start % 64 == 0 for r in got) and len({r.doc_id for r in got}) == 300


def test_packing(spark, odd):
    got = packing.pack(odd).collect()
    ids = collections.defaultdict(list)
    for r, e in zip(odd_rows(), encoded([r[1] for r in odd_rows()]), strict=True):
        ids[r[0]].append([*e, 2])
    assert sum(r.length for r in got) == sum(len(e) for v in ids.values() for e in v)
    for r in got:
        assert any(len(e) == r.doc_tokens and zlib.crc32(np.array(e[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for e in ids[r.doc_id])
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert sum(r.length for r in got) > 0.9 * packing.WINDOW * (len(places) - 1)


@pytest.mark.parametrize("prior, negative", [(0.2, False), (0.9, True)])
def test_non_negative_risk_and_its_gradient(prior, negative):
    rng = np.random.default_rng(7)
    z = rng.normal(size=30)
    plus, unl = slice(0, 10), slice(10, 30)
    loss = lambda m: float(np.log1p(np.exp(-m)).mean())

    def plain(z):
        return prior * loss(z[plus]), loss(-z[unl]) - prior * loss(-z[plus])

    if negative:
        z[unl] -= 4
    score = toxicity.sigmoid(z)
    assert toxicity.nn_risk(score[plus], score[unl], prior) == pytest.approx(plain(z), rel=1e-9) and (plain(z)[1] < 0) == negative
    followed = (lambda z: -plain(z)[1]) if negative else (lambda z: sum(plain(z)))
    step = 1e-6 * np.eye(30)
    numeric = [(followed(z + s) - followed(z - s)) / 2e-6 for s in step]
    assert np.concatenate(toxicity.nn_gradient(score[plus], score[unl], prior)) == pytest.approx(numeric, abs=1e-6)


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(200)]
    rows, marks = [], []
    for i in range(1500):
        toxic = i % 10 == 0
        rows.append((i, " ".join([*rng.choice(words, 30), *(["Vile!", "nasty"] if toxic else [])]), "en", "s", None))
        if i % 3 == 0:
            marks.append((i, 1, int(toxic)))
    got = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(rows, DOCS), labels_of(spark, marks)).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.3) for i in got)
    assert all(got[i].predicted == int(i % 10 == 0) for i in held)
    assert len(toxicity.keep_clean(clashing(spark.createDataFrame(rows, DOCS)), labels_of(spark, marks)).columns) == len(clashing(spark.createDataFrame(rows, DOCS)).columns)


def test_held_out_labels_are_never_used(spark):
    rows = [(i, f"a{i % 7} b{i % 5}", "en", "s", None) for i in range(300)]
    marks = lambda flip: [(i, 1, int(i % 6 == 0) ^ (flip and zlib.crc32(str(i).encode()) % 4 == 2)) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity(df, labels_of(spark, marks(f))).collect()} for f in (False, True))
    assert a == b


def test_toxicity_without_positives(spark, odd):
    assert {r.score for r in toxicity.toxicity(odd, labels_of(spark, [(1, 1, 0)])).collect()} == {0.0}


def test_url_filter_follows_the_dates(spark):
    entries = spark.createDataFrame([("Bad.example", "add", "2024-01-10"), ("bad.example", "remove", "2024-03-01"), ("bad.example", "remove", "2024-03-01"), ("bad.example", "add", "2024-04-01"),
                                     ("ok.example/ads", "add", "2023-01-01"), (None, "add", "2024-01-01"), ("x", "noise", "2024-01-01")], "key string, action string, since string")
    urls = [("http://bad.example/", "2024-01-09"), ("http://a.b.bad.example:80/x", "2024-01-10"), ("http://u@BAD.example./", "2024-02-29"), ("http://bad.example", "2024-03-01"), ("http://bad.example", "2030-01-01"),
            ("https://ok.example/ads/1?x", "2024-01-01"), ("https://ok.example/adsx", "2024-01-01"), ("https://www.ok.example/ads", "2024-01-01"), ("http://notbad.example", "2024-01-20"), (None, "2024-01-20"), ("junk", "2024-01-20"), ("http://bad.example", None)]
    df = clashing(spark.createDataFrame([(i, *u) for i, u in enumerate(urls)], "page_id long, url string, fetched string"))
    got = {r.page_id: r for r in urlfilter.url_filter(df, entries).collect()}
    assert [got[i].blocked for i in range(len(urls))] == [False, True, True, False, True, True, False, False, False, False, False, False]
    assert str(got[4].listed_since) == "2024-04-01" and got[1].matched_key == "bad.example" and got[5].matched_key == "ok.example/ads"


def library_ids(texts):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model()).encode(texts, num_threads=1)


def test_ids_are_those_of_the_library(spark):
    """Marks in a text are characters here and spaces to the library, so texts with marks are left out."""
    texts = [r[1] or "" for r in odd_rows()] + ["a   b", " lead", "trail  ", "\n\n x \n", "naïve café", "x" * 500, "abcABC" * 80, "漢字 🙂 \x1c", "don't  stop"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r.text]
    texts = [t for t in texts if pieces.MARK not in t]
    ids, b = pieces.Pieces.of(pieces.default_model()).encode(pa.array(texts))
    assert [ids[s:e].tolist() for s, e in zip(b, b[1:], strict=False)] == library_ids(texts)


def test_paths_do_not_depend_on_the_words_before():
    p = pieces.Pieces.of(pieces.default_model())
    words = [" unbelievable", " unbelievably", " un", " x漢", " x漢字", " believable", ""]
    alone = [p.ids_of([w])[0] for w in words]
    assert p.ids_of(words) == alone and p.merges(" unbelievable") == [p.data[i].decode() for i in np.frombuffer(alone[0], "<u4")]


def test_viterbi_is_the_best_of_all_splits():
    p = pieces.Pieces(pieces.default_model(), pieces.UNIGRAM)

    def best(word):
        top = [0.0] + [float("-inf")] * len(word)
        for e in range(1, len(word) + 1):
            top[e] = max([top[e - 1] + p.unknown] + [top[b] + p.score[word[b:e]][0] for b in range(e) if word[b:e] in p.score])
        return top[-1]

    words = [" the", " thethe", "there", " naïve", "▁", "zz漢", "  x", " " + "a" * 40]
    for word, ids in p.search(words):
        own = np.frombuffer(ids, "<u4").tolist()
        fallback = set(p.byte_id.tolist())
        loose = sum(1 for c in word if c not in p.letters)
        assert sum(p.score[p.data[i].decode()][0] for i in own if i not in fallback) + loose * p.unknown == pytest.approx(best(word), rel=1e-12)


def test_no_split_of_the_library_scores_better():
    sp = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(pieces.default_model(), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    library = sp.SentencePieceProcessor(model_proto=m.SerializeToString())
    words = ["the", "thaner", "with", "nteres", "réeux", "Straße"]
    ids, b = pieces.Pieces(pieces.default_model(), pieces.UNIGRAM).encode(pa.array(words))
    score = lambda own: sum(m.pieces[i].score for i in own)
    for s, e, other in zip(b, b[1:], library.encode(words), strict=False):
        own = ids[s:e].tolist()
        assert library.decode(own) == library.decode(other) and score(own) >= score(other)


def test_long_words_take_little_memory():
    """A text without spaces is one word: 12 bytes a character for the search, and no cache holds it."""
    import tracemalloc

    p = pieces.Pieces.of(pieces.default_model())
    text = "abcdefghij漢" * 30_000
    tracemalloc.start()
    ids, bounds = p.encode(pa.array([text]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert p.decode(ids, bounds) == [text.encode()] and peak < 50 * len(text) and not any(len(w) > 300 for w in p.known.known)


def test_caches_start_anew_when_full():
    from lumenframe.llm.text import Remembered

    held = Remembered(most=10_000, longest=5)
    make = lambda new: [v.encode() for v in new]
    for i in range(300):
        assert held.parts([f"v{i}", "too long for it"], make) == [f"v{i}".encode(), b"too long for it"]
    assert held.held < 11_000 and "too long for it" not in held.known and "v299" in held.known


def test_common_prefix():
    for a, b in (("", "x"), ("abc", "abd"), ("x" * 1000 + "a", "x" * 1000 + "b"), ("same", "same"), ("ab" * 500, "ab" * 400 + "b")):
        n = pieces.common_prefix(a, b)
        assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


def test_round_trips_are_exact(spark, odd):
    got = pieces.round_trip(odd).collect()
    assert all(r.exact for r in got) and {r.n_pieces for r in got if r.doc_id in (0, 1)} == {0}


def plain_fingerprint(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    root = {i: i for i, _ in fps}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in fps:
        for b, y in fps:
            if a < b and (x ^ y).bit_count() <= 2:
                i, j = top(a), top(b)
                root[max(i, j)] = min(i, j)
    return {i: top(i) for i, _ in fps}


@pytest.mark.parametrize("largest", [512, 3])
def test_simhash_links(spark, largest):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 12)
    fps = []
    for i in range(400):
        x = int(base[i % 12])
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            x ^= 1 << int(b)
        fps.append(x)
    fps = list(enumerate(dict.fromkeys(fps)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for _, x in fps], "fp long")
    from lumenframe.llm.components import components

    roots = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in components(simhash.links(df, largest)).collect()}
    want = plain_components(fps)
    number = {x: i for i, x in fps}
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert groups({i: number[roots.get(x, x)] for i, x in fps}) == groups(want)


def test_simhash_groups(spark, odd):
    rows = [r for r in odd_rows() if r[0] is not None]
    got = {r.doc_id: r for r in simhash.simhash_groups(odd).collect() if r.doc_id is not None}
    fps = [(i, x) for i, x in {r[0]: plain_fingerprint(r[1]) for r in rows}.items()]
    assert {i: int(got[i].fingerprint, 16) for i, _ in fps} == dict(fps)
    assert {i: got[i].component_id for i in got} == plain_components(fps)


def test_components_of_a_long_path(spark):
    from lumenframe.llm.components import components

    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(900, 901), (901, 900), (5, 5)], "a long, b long"))
    got = components(edges).collect()
    assert len({r.root for r in got}) == 2 and len(got) == 203


def test_near_copies_leave_one_of_each_group(spark, odd):
    kept = simhash.drop_near_copies(clashing(drop_copies(odd)))
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids[0] == 2 and len(ids) == len(set(ids)) and kept.columns == clashing(odd).columns


def test_text_ids_of_fingerprints(spark):
    """Ids that aren't numbers are cut into ranges too, and each document meets the next in descending order."""
    from lumenframe.llm.lzprint import neighbour_fingerprints

    rows = [(f"d{i:03d}", f"text {i} " * (i % 7)) for i in range(200)]
    got = {r.doc_id: (r.n_chars, r.edited_sha256) for r in neighbour_fingerprints(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    texts = dict(rows)
    for i, (key, text) in enumerate(rows):
        following, third = texts[rows[i - 1][0]], len(text) // 3
        assert got[key] == (len(text), hashlib.sha256((text[: len(text) - third] + following[:third]).encode()).hexdigest())


def test_masking_leaves_a_length_that_is_none(spark):
    from lumenframe.llm.secrets import mask_secrets

    rows = [(1, 'token = "abcd1234efgh5678"', "many"), (2, "plain", None)]
    got = mask_secrets(spark.createDataFrame([(*r, "o/r") for r in rows], "doc_id long, text string, n_chars string, source string")).collect()
    assert {(r.doc_id, r.text.count("<secret>"), r.n_chars) for r in got} == {(1, 1, "many"), (2, 0, None)}
