"""Connected components of a graph of long ids, by repeated contraction in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import scratch
from lumenframe.llm.skew import hot_keys, join_hot


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (a, b long): nodes have one root where a path joins them.

    In each round every node follows its least neighbour (by a hash, so that long paths contract too),
    edges are drawn anew between the nodes followed, and equal or inner edges go; the rounds end when no
    edge is left.  Then the rounds are put together from the last to the first.  Only aggregations and joins of stored tables, in
    which nodes with very many edges, or followers, are salted; nothing but counts comes to the driver.
    """
    order = lambda c: F.xxhash64(c)
    both = edges.filter("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    live = scratch.table(both.distinct(), "edges")
    steps: list[DataFrame] = []
    while live.limit(1).count():
        least = F.min(F.struct(order(F.col("b")).alias("o"), F.col("b").alias("n"))).alias("m")
        to = F.when(F.col("m.o") < order(F.col("a")), F.col("m.n")).otherwise(F.col("a"))
        step = scratch.table(live.groupBy("a").agg(least, F.count("*").alias("degree")).select(F.col("a").alias("node"), to.alias("next"), "degree"), "step")
        steps.append(step.select("node", "next"))
        hot = hot_keys(step, "node", "degree")
        ends = lambda end, to: step.select(F.col("node").alias(end), F.col("next").alias(to))
        drawn = join_hot(live, ends("a", "na"), "a", "", "b", hot=hot)
        drawn = join_hot(drawn, ends("b", "nb"), "b", "", "a", hot=hot)
        live = scratch.table(drawn.filter("na <> nb").select(F.col("na").alias("a"), F.col("nb").alias("b")).distinct(), "edges")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    out = steps[-1].select("node", F.col("next").alias("root"))
    for step in reversed(steps[:-1]):
        out = scratch.table(out, "roots")
        followers = step.groupBy("next").agg(F.count("*").alias("n"))
        out = join_hot(step, out.select(F.col("node").alias("next"), "root"), "next", "", "node", "left", hot_keys(followers, "next", "n"))
        out = out.select("node", F.coalesce("root", "next").alias("root"))
    return out
