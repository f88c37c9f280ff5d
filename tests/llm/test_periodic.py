"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tests.llm.common import DOCS, WORD, clashing, odd_rows

periodic = pytest.importorskip("lumenframe.llm.periodic")


def plain_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            if length >= max(6, 4 * q) and not any(all(w[j] == w[j + r] for j in range(start, start + length - r)) for r in range(1, q)):
                out.append((start, length, q))
    return sorted(out)


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def random_words(rng, most=150):
    w = []
    while rng.random() < 0.85 and len(w) < most:
        block = [rng.choice("abc") for _ in range(rng.randrange(1, 9))]
        w += (block * rng.randrange(1, 9))[: rng.randrange(1, 60)] if rng.random() < 0.6 else [rng.choice("abcd") for _ in range(rng.randrange(8))]
    return w


def test_all_runs_are_found():
    rng = random.Random(3)
    for _ in range(150):
        texts = [random_words(rng) for _ in range(4)]
        codes, bounds = np.array([ord(x) for w in texts for x in w], np.int64), np.cumsum([0, *map(len, texts)])
        assert [tuple(r) for r in periodic.find_runs(codes, bounds).tolist()] == [(i, *r) for i, w in enumerate(texts) for r in plain_runs(w)]


def test_long_periods_and_one_word_a_million_times():
    w = np.random.default_rng(1).integers(0, 1 << 40, 5000)
    codes = np.concatenate([[1, 2], np.tile(w, 5)[:20_017], [3]])
    assert periodic.find_runs(codes, np.array([0, len(codes)])).tolist() == [[0, 2, 20_017, 5000]]
    assert periodic.find_runs(np.zeros(1 << 20, np.int64), np.array([0, 0, 1 << 20])).tolist() == [[1, 0, 1 << 20, 1]]


def test_rows_of_a_table(spark):
    rng = random.Random(4)
    rows = odd_rows() + [(100 + i, " ".join(random_words(rng)), None, None, None) for i in range(60)] + [(500, "x \t" * 40, None, None, None)]
    got = periodic.periodic_runs(clashing(spark.createDataFrame(rows, DOCS))).collect()
    want = []
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        # Only short texts and those known to have none are searched the plain way.
        runs = plain_runs(w) if len(w) < 1000 else []
        want.append((i, len(w), tuple(runs), collapsed(w, runs)))
    assert sorted(map(repr, ((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in got))) == sorted(map(repr, want))
    assert periodic.periodic_runs(spark.createDataFrame([], DOCS)).collect() == []


def test_query_plants_cycles_and_takes_the_greatest_exponent(spark, tmp_path):
    from lumenframe.llm.queries import op12_periodic_runs

    rng = random.Random(6)
    rows = [(i, " ".join(random_words(rng) + [rng.choice("abcdefgh") for _ in range(rng.randrange(60))]) or None) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    planted = 0
    for r in op12_periodic_runs(spark, str(tmp_path)).collect():
        w = WORD.findall(dict(rows)[r.doc_id] or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w, planted = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)], planted + 1
        runs = plain_runs(w)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        said = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        kept = hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
        assert tuple(r) == (r.doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, said, kept)
    assert planted > 15
