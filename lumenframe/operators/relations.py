"""Losses between the token relations of a student and a teacher, as sums over blocks of the two cosine matrices.

Tokens are rows (item, frame, token, vector).  Those of a frame are laid into tiles of TILE tokens, and each two tiles meet in one group, where a matrix product of each side
gives a block of relations that is reduced to two sums at once.  So there is never a row for a pair of tokens, a task holds two tiles, and a frame of any size is
spread over its blocks.  Pooling and matching in time are groupings of the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import arrays as A

#: Tokens of a tile.
TILE = 256
TOKENS, MARGIN = 64, 0.1


def summed(vectors: Column, weights: Column) -> Column:
    """Weighted sum of an array of vectors."""
    scaled = F.zip_with(vectors, weights, lambda v, w: F.transform(v, lambda x: x.cast("double") * w))
    return F.aggregate(F.slice(scaled, F.lit(2), F.size(scaled)), F.get(scaled, F.lit(0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))


def pool_tokens(tokens: DataFrame, size: int = TOKENS) -> DataFrame:
    """``tokens`` (item, frame, token, vector; tokens from 0) pooled to ``size`` in each frame: bin i averages from floor(i n / size) to ceil((i + 1) n / size).

    A frame that has ``size`` tokens stays.  A group holds the tokens of one bin.
    """
    n = tokens.groupBy("item", "frame").agg((F.max("token") + 1).cast("long").alias("n"))
    k = F.col("token").cast("long")
    first, last = F.floor(k * size / F.col("n")), F.ceil((k + 1) * size / F.col("n")) - 1
    binned = tokens.join(n, ["item", "frame"]).withColumn("bin", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    held = F.sort_array(F.collect_list(F.struct("token", "vector")))
    share = lambda rows: F.array_repeat(1.0 / F.size(rows), F.size(rows))
    out = binned.groupBy("item", "frame", "bin").agg(held.alias("rows"))
    return out.select("item", "frame", F.col("bin").alias("token"), summed(F.col("rows.vector"), share(F.col("rows"))).alias("vector"))


def match_time(tokens: DataFrame, frames: DataFrame) -> DataFrame:
    """``tokens`` (frames from 0) with as many frames as ``frames`` (item, target) says, linearly interpolated between frame centres."""
    n = tokens.groupBy("item").agg((F.max("frame") + 1).cast("long").alias("n")).join(frames, "item")
    place = lambda i: F.greatest((i + 0.5) * F.col("n") / F.col("target") - 0.5, F.lit(0.0))
    low = lambda i: F.least(F.floor(place(i)), F.col("n") - 1)
    # Where each new frame comes from: two old frames and their weights.
    plan = n.select("item", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("target").cast("long") - 1), lambda i: F.struct(
        i.alias("to"), low(i).cast("long").alias("a"), F.least(low(i) + 1, F.col("n") - 1).cast("long").alias("b"), (place(i) - low(i)).alias("w")))).alias("p"))
    plan = plan.select("item", "p.to", F.explode(F.array(F.struct(F.col("p.a").alias("from"), (1 - F.col("p.w")).alias("w")), F.struct(F.col("p.b").alias("from"), F.col("p.w").alias("w")))).alias("s")).select("item", "to", "s.*")
    met = tokens.withColumnRenamed("frame", "from").join(plan, ["item", "from"])
    rows = met.groupBy("item", "to", "token").agg(F.sort_array(F.collect_list(F.struct("from", "w", "vector"))).alias("rows"))  # two of each
    return rows.select("item", F.col("to").alias("frame"), "token", summed(F.col("rows.vector"), F.col("rows.w")).alias("vector"))


def frame_means(tokens: DataFrame) -> DataFrame:
    """item, token (the frame), vector: the mean token of each frame, added up by place in the vector."""
    each = tokens.select("item", "frame", F.posexplode("vector").alias("place", "x")).groupBy("item", "frame", "place").agg(F.avg("x").alias("x"))
    rows = each.groupBy("item", "frame").agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("v"))
    return rows.select("item", F.col("frame").alias("token"), F.col("v.x").alias("vector"))


def unit_tokens(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("vector", A.unit(F.col("vector")))


def tiles_of(tokens: DataFrame, columns: list[str], tile: int) -> DataFrame:
    """item, frame, tile, last (tile of the frame), and for each of ``columns`` (vectors) the tile's vectors in the order of their tokens."""
    last = tokens.groupBy("item", "frame").agg(F.expr(f"CAST(max(token) AS bigint) div {tile}").alias("last"))
    held = F.sort_array(F.collect_list(F.struct("token", *columns))).alias("rows")
    laid = tokens.withColumn("tile", F.expr(f"CAST(token AS bigint) div {tile}")).groupBy("item", "frame", "tile").agg(held)
    return laid.join(last, ["item", "frame"]).select("item", "frame", "tile", "last", *[F.col(f"rows.{c}").alias(c) for c in columns])


def tile_pairs(tiles: DataFrame, columns: list[str]) -> DataFrame:
    """Each two tiles i <= j of a frame in one row: item, frame, i, j, and each column of both, as c and c_j."""
    one = tiles.withColumn("j", F.explode(F.sequence("tile", "last"))).withColumnRenamed("tile", "i").drop("last")
    other = tiles.select("item", "frame", F.col("tile").alias("j"), *[F.col(c).alias(f"{c}_j") for c in columns])
    return one.join(other, ["item", "frame", "j"])


def matrix(vectors: pa.ListScalar) -> np.ndarray:
    """Vectors as the rows of a matrix; nulls are 0."""
    rows = vectors.values
    flat = rows.flatten()
    return np.nan_to_num(flat.to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(rows), -1)


def block_sums(student: DataFrame, teacher: DataFrame, margin: float = MARGIN, tile: int = TILE) -> DataFrame:
    """item, frame, and over the pairs of tokens of a frame that both sides have: squares (of the difference of the products), beyond (how far it is over the margin), diagonal (the
    part of that from a token with itself) and pairs.

    ``student`` and ``teacher`` are rows (item, frame, token, vector).  Nulls in a vector count as 0.
    """
    kinds = {f.name: f.dataType.simpleString() for f in student.schema}
    both = student.withColumnRenamed("vector", "s").join(teacher.withColumnRenamed("vector", "t"), ["item", "frame", "token"])
    met = tile_pairs(tiles_of(both, ["s", "t"], tile), ["s", "t"]).select("item", "frame", "i", "j", "s", "t", "s_j", "t_j")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, j, *vectors in zip(b.column("i").to_pylist(), b.column("j").to_pylist(), *(b.column(c) for c in ("s", "t", "s_j", "t_j")), strict=True):
                s, t, s_j, t_j = map(matrix, vectors)
                apart = s @ s_j.T - t @ t_j.T
                over, times = np.maximum(np.abs(apart) - margin, 0), 1 + (i != j)
                out.append((times * float((apart**2).sum()), times * float(over.sum()), float(np.trace(over)) if i == j else 0.0, times * apart.size))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([o[k] for o in out], t) for k, t in enumerate((pa.float64(),) * 3 + (pa.int64(),))]], ["item", "frame", "squares", "beyond", "diagonal", "pairs"])

    parts = met.mapInArrow(blocks, f"item {kinds['item']}, frame {kinds['frame']}, squares double, beyond double, diagonal double, pairs long")
    return parts.groupBy("item", "frame").agg(*[F.sum(c).alias(c) for c in ("squares", "beyond", "diagonal", "pairs")])


def relation_blocks(tokens: DataFrame, tile: int = TILE) -> DataFrame:
    """item, frame, i, j (first tokens of two tiles, i <= j), cos: a block of the cosine matrix as an array of rows."""
    kinds = {f.name: f.dataType.simpleString() for f in tokens.schema}

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(matrix(x) @ matrix(y).T).tolist() for x, y in zip(b.column("vector"), b.column("vector_j"), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("item", "frame", "i", "j")], pa.array(made, pa.list_(pa.list_(pa.float64())))], ["item", "frame", "i", "j", "cos"])

    met = tile_pairs(tiles_of(unit_tokens(tokens), ["vector"], tile), ["vector"]).select("item", "frame", (F.col("i") * tile).alias("i"), (F.col("j") * tile).alias("j"), "vector", "vector_j")
    return met.mapInArrow(blocks, f"item {kinds['item']}, frame {kinds['frame']}, i long, j long, cos array<array<double>>")


def simple_relation_loss(student: DataFrame, teacher: DataFrame, wt: float = 1.0, ws: float = 1.0) -> DataFrame:
    """Mean square difference of all relations times the mean weight, of unit tokens (item, frame, token, vector)."""
    sums = block_sums(unit_tokens(student), unit_tokens(teacher))
    return sums.agg((F.sum("squares") / F.sum("pairs") * ((wt + ws) / 2)).alias("loss"))


def relation_distillation(student: DataFrame, teacher: DataFrame, tokens: int = TOKENS, margin: float = MARGIN, spatial_weight: float = 1.0, temporal_weight: float = 1.0) -> DataFrame:
    """item, spatial, temporal, total: the teacher is matched to the student's frames, both are pooled to ``tokens``, and relations of unit tokens compared.

    Spatial: the mean over frames and pairs of tokens of how far the relations differ beyond the margin.  Temporal: the same over pairs of different frames' mean tokens,
    divided by their number (1 at least).
    """
    frames = student.groupBy("item").agg((F.max("frame") + 1).cast("long").alias("target"))
    s, t = (unit_tokens(pool_tokens(x, tokens)) for x in (student.withColumn("frame", F.col("frame").cast("long")), match_time(teacher, frames)))
    spatial = block_sums(s, t, margin).groupBy("item").agg((F.sum("beyond") / F.sum("pairs")).alias("spatial"), F.count("*").alias("n"))
    means = [frame_means(x).withColumn("frame", F.lit(0)) for x in (s, t)]
    temporal = block_sums(*means, margin).select("item", (F.col("beyond") - F.col("diagonal")).alias("off"))
    both = spatial.join(temporal, "item")
    out = both.select("item", "spatial", (F.col("off") / F.greatest(F.col("n") * (F.col("n") - 1), F.lit(1))).alias("temporal"))
    return out.withColumn("total", spatial_weight * F.col("spatial") + temporal_weight * F.col("temporal"))
