"""The forest of signatures against all pairs of shingle sets."""

import collections
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.common import DOCS, WORD, clashing, odd_rows

forest = pytest.importorskip("lumenframe.llm.forest")


def shingles(text, size=2):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def plain_components(texts, size=2):
    """(set size, smallest id reachable) of each id; similar sets share one of the rarest fifth of their shingles (and one more), so no pair is passed over."""
    sets = {i: shingles(t, size) for i, t in texts.items()}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    uses, holders = collections.Counter(s for own in sets.values() for s in own), collections.defaultdict(list)
    for i in sorted(sets, key=lambda i: (len(sets[i]), i)):
        own = sets[i]
        rare = sorted(own, key=lambda s: (uses[s], s))[: len(own) - -(-4 * len(own) // 5) + 1] if own else []
        for j in {j for s in rare for j in holders[s]}:
            a, b = sorted((top(i), top(j)))
            shared = len(own & sets[j]) if a != b else 0
            if a != b and 100 * shared >= 80 * (len(own) + len(sets[j]) - shared):
                root[b] = a
        for s in rare:
            holders[s].append(i)
    return {i: (len(sets[i]), top(i)) for i in sets}


def of(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def families(seed, groups=25, copies=12):
    """Groups of copies with a few to many words changed, cut or swapped, and chains of copies of copies."""
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        made = [[f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 2, 5, 11, 40, 120, 400]))]]
        for _ in range(copies):
            text = list(rng.choice(made[-2:] if rng.random() < 0.5 else made[:1]))
            for _ in range(rng.randrange(1 + len(text) // 16)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(3000)}"
            made.append(text[: len(text) - rng.randrange(1 + len(text) // 9)])
        out += [" ".join(t) for t in made]
    rng.shuffle(out)
    return dict(enumerate(out))


def test_components_are_those_of_all_pairs(spark):
    texts = families(1)
    got = forest.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    want = plain_components(texts)
    assert of(got) == want and len(set(want.values())) < 0.7 * len(want)


@pytest.mark.parametrize("largest", [64, 4])
def test_crowded_regions_lose_no_link(spark, largest):
    """All sets in one region of the first level, which are dealt by the deeper levels, by a large class, and by blocks at last."""
    from lumenframe.llm import scratch

    texts = families(3, 18, 12)
    texts |= {1000 + i: " ".join([*(f"q{k}" for k in range(60)), f"only{i}"]) for i in range(40)}
    rows = spark.createDataFrame(list(texts.items()), "id long, text string").withColumn("t", forest.text_name(F.col("text")))
    marked = scratch.table(forest.marks(rows, 2, False).dropDuplicates(["s"]), "test-marks")
    for orders in (forest.ORDERS, 0):  # with neighbours, and without
        nodes = scratch.table(marked.withColumn("node", F.col("id")).withColumn("shards", F.array(F.lit(1).cast("long"))).withColumn("orders", F.slice("orders", 1, orders)), "test-nodes")
        pair = forest.links(nodes, lambda some: some.join(rows.select(F.col("id").alias("node"), "text"), "node"), 2, 4, largest=largest)
        found = pair[0].select("a", "b").unionByName(pair[2].select("a", "b"))
        root = {r.node: r.root for r in forest.classes(nodes, *pair).collect()}
        want = plain_components({r.id: texts[r.id] for r in marked.select("id").collect()})
        sets = {i: shingles(t) for i, t in texts.items()}
        for r in found.collect():
            shared = len(sets[r.a] & sets[r.b])
            assert 100 * shared >= 80 * len(sets[r.a] | sets[r.b])
        least = {}
        for i in want:
            least[root.get(i, i)] = min(i, least.get(root.get(i, i), i))
        assert {i: least[root.get(i, i)] for i in want} == {i: c for i, (_, c) in want.items()}


def test_rows_of_a_crowded_region_follow_its_sets(spark):
    """One region of 2,000 and one of 8,000 unlike sets, half of whose shingles are one passage."""
    from lumenframe.llm import scratch

    made = {}
    for n in (2000, 8000):
        rng = random.Random(n)
        texts = [" ".join([*(f"p{k}" for k in range(30)), *(f"w{rng.randrange(1 << 40)}" for _ in range(30))]) for _ in range(n)]
        sets = scratch.table(forest.sets_of(spark.createDataFrame(list(enumerate(texts)), "node long, text string"), 2), "test-sets")
        members = sets.select(F.lit(1).cast("long").alias("shard"), F.lit(n).cast("long").alias("n"), "node", F.size("set").cast("long").alias("size"), F.col("node").alias("root"), F.array(F.lit(1).cast("long")).alias("keys"), F.array().cast("array<long>").alias("sketch"), F.lit(0).cast("long").alias("fp"))
        members = scratch.table(members.withColumns({"most": F.lit(1).cast("long"), "top": F.lit(0).cast("long")}), "test-members")
        made[n] = forest.cells(members, members, sets, 4, 256).count()
    assert made[8000] < 4.5 * made[2000] + 1000 and made[8000] < 20 * 8000


def test_one_class_in_a_crowded_region_meets_the_others(spark):
    from lumenframe.llm import scratch

    rows = [(1, 5010, i, 50, 0 if i < 5000 else i, 5000, 0, [1], [], 0) for i in range(5010)]
    members = scratch.table(spark.createDataFrame(rows, "shard long, n long, node long, size long, root long, most long, top long, keys array<long>, sketch array<long>, fp long"), "test-members")
    met = forest.cells(members, members, None, 4, 256)
    cells = collections.defaultdict(set)
    for r in met.collect():
        cells[r.cell].add(r.node)
    pairs = {(a, b) for own in cells.values() for b in own if b >= 5000 for a in own if a < b}
    assert len(pairs) == 10 * 5000 + 45 and max(map(len, cells.values())) < 300 and sum(map(len, cells.values())) < 6000


def test_odd_rows(spark):
    rows = odd_rows()
    got = forest.near_duplicates(clashing(spark.createDataFrame(rows, DOCS))).collect()
    want = plain_components({i: t for i, t, *_ in rows if i is not None})
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    # A null text without an id is alone; a null id takes the component of its text.
    assert sorted((r.n_shingles, r.component_id or -1, r.kept) for r in got if r.doc_id is None) == [(0, -1, True), (5, 6, False)]
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert forest.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_text_ids(spark):
    got = forest.near_duplicates(spark.createDataFrame([("b", "one two three"), ("a", "One two  three"), ("c", "x")], "doc_id string, text string"))
    assert of(got) == {"a": (2, "a"), "b": (2, "a"), "c": (1, "c")}


def test_whole_table(spark):
    f = "/root/testdata/sf0.01/documents.parquet"
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{f}'").fetchall())
    assert of(forest.near_duplicates(spark.read.parquet(f))) == plain_components(texts)
