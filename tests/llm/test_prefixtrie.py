"""The prefix trie of conversations against a plain one."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

prefixtrie = pytest.importorskip("lumenframe.llm.prefixtrie")
TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def plain_trie(rows, lent=lambda c: 0, lender=lambda c: c):
    """Every node by its prefix; all sums are made by walking from each node to the root."""
    turns = collections.defaultdict(list)
    for c, t, r, x in rows:
        r, x = r or "", x or ""
        if c is not None:
            turns[c].append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest(), r, x))
    turns = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in turns.items()}
    built = {c: turns.get(lender(c), [])[: lent(c)] + v[lent(c) :] for c, v in turns.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, v in sorted(built.items()):
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
            leaves[k[:d]] += not children[k]
    return sorted((m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, m in members.items())


def of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def random_turns(seed, n=160, most=14):
    rng = random.Random(seed)
    rows, made = [], []
    for c in rng.sample(range(400), n):
        own = list(rng.choice(made)[: rng.randrange(most)]) if made and rng.random() < 0.7 else []
        own += [(rng.choice(["user", "assistant", None]), rng.choice(["", "a", "bb", "ccc", "é漢🙂", None])) for _ in range(rng.randrange(most))]
        made.append(own)
        rows += [(c, t * 3 - 5 if t else None, r, x) for t, (r, x) in enumerate(own)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    rows = random_turns(seed)
    df = spark.createDataFrame(rows, TURNS)
    assert of(prefixtrie.prefix_trie(df)) == plain_trie(rows)
    assert of(prefixtrie.prefix_trie(df, lent=F.crc32(F.col("c").cast("string")) % 6, lender=F.col("c") - F.col("c") % 100)) == plain_trie(rows, lambda c: zlib.crc32(str(c).encode()) % 6, lambda c: c - c % 100)


def test_long_conversations_and_one_with_most_turns(spark, monkeypatch):
    """Conversations of many groups of blocks, in many ranges; copies, and prefixes of others, among them."""
    monkeypatch.setattr(prefixtrie, "GROUP", 3)
    monkeypatch.setattr(prefixtrie, "TASK_ROWS", 50)
    rng = random.Random(5)
    long = [("user", str(rng.randrange(9))) for _ in range(400)]
    talks = {7: long, 8: long, 9: long[:123], 10: [*long[:123], ("user", "other")], 11: long[:4], 12: [*long[:200], *long[:17]], 13: [], 500: long[1:90]}
    talks |= {i: [("user", "hi")] for i in range(20, 60)}
    rows = [(c, t, *x) for c, v in talks.items() for t, x in enumerate(v)]
    rng.shuffle(rows)
    assert of(prefixtrie.prefix_trie(spark.createDataFrame(rows, TURNS))) == plain_trie(rows)


def test_odd_rows(spark):
    """Nulls in any column, ties, repeated rows, extra columns, turnless conversations, and none at all."""
    rows = [(1, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "b"), (1, 0, "user", "a"), (2, 5, "user", "a"), (2, 5, "user", "a"), (None, 1, "user", "x"), (None, None, None, None), (3, None, "", ""), (201, 1, "user", "z" * 300_000)]
    df = spark.createDataFrame(rows, TURNS)
    wide = df.withColumns({c: F.lit("1") for c in ("c", "r", "dig", "len", "n", "node", "depth", "L", "own", "cum")})
    assert of(prefixtrie.prefix_trie(wide)) == plain_trie(rows)
    gone = [(201, 1, "user", "gone")]
    got = of(prefixtrie.prefix_trie(spark.createDataFrame(gone, TURNS), lent=F.lit(5), lender=F.lit(0).cast("long")))
    assert got == plain_trie(gone, lambda c: 5, lambda c: 0) and got[0][5] == 1  # the root is the only leaf
    assert of(prefixtrie.prefix_trie(df.limit(0))) == []
