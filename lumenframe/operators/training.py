"""Closed forms around training: noise schedule, step counts, flow matching and token relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lumenframe.functions import arrays as A
from lumenframe.functions import expr as E

# Fixed values of the noise schedule.
STEPS, SHIFT, BOUNDARY = 1000, 10.0, 0.947


def noise_schedule(spark: SparkSession, steps: int = STEPS, shift: float = SHIFT, boundary: float = BOUNDARY) -> DataFrame:
    """idx, sigma, timestep, branch, weight (mean 1 over all), branch_weight (mean 1 in its branch)."""
    base = spark.range(steps).select(F.col("id").cast("int").alias("idx"), (1 - F.col("id") / F.lit(float(steps))).alias("u"))
    base = base.withColumn("sigma", shift * F.col("u") / (1 + (shift - 1) * F.col("u"))).withColumn("timestep", F.col("sigma") * steps)
    base = base.withColumn("branch", F.when(F.col("timestep") < boundary * steps, "low").otherwise("high"))
    bell = F.exp(-2 * F.pow((F.col("timestep") - steps / 2) / steps, F.lit(2.0)))
    every = Window.partitionBy(F.lit(0))  # a fixed number of rows
    raw = base.withColumn("y", bell).withColumn("y", F.col("y") - F.min("y").over(every))
    raw = raw.withColumn("w", F.col("y") * steps / F.sum("y").over(every))
    return raw.select("idx", "sigma", "timestep", "branch", (F.col("w") / F.avg("w").over(every)).alias("weight"), (F.col("w") / F.avg("w").over(Window.partitionBy("branch"))).alias("branch_weight"))


def sample_timesteps(df: DataFrame, schedule: DataFrame, branch: str, seed: int, key: str | None = None) -> DataFrame:
    """A uniform index of the branch for each row, with its weight; other libraries' generators aren't repeated.

    With ``key`` the index is a hash of the key and the seed, so it stays the same however the rows are dealt; without it the rows'
    places count.
    """
    picks = schedule.filter(F.col("branch") == branch).select(F.row_number().over(Window.partitionBy("branch").orderBy("idx")).alias("_k"), "idx", "sigma", F.col("branch_weight").alias("weight"))
    n = picks.count()
    drawn = E.seeded(F.col(key), seed) % max(n, 1) if key else F.floor(F.rand(seed) * n)
    return df.withColumn("_k", (drawn + 1).cast("int")).join(F.broadcast(picks), "_k").drop("_k")  # at most the schedule's steps


def noised(x: Column, noise: Column, sigma: Column) -> Column:
    return F.zip_with(x, noise, lambda a, e: (1 - sigma) * a + sigma * e)


def flow_loss(df: DataFrame, x: str, noise: str, predicted: str, weight: str, skip: int = 0) -> DataFrame:
    """Weighted mean square of predicted less (noise - x), without the first ``skip`` values of each array."""
    target = F.zip_with(noise, x, lambda e, a: e.cast("double") - a.cast("double"))
    cut = lambda c: F.slice(c, skip + 1, 1 << 30)
    square = F.zip_with(cut(F.col(predicted)), cut(target), lambda p, t: (p.cast("double") - t) * (p.cast("double") - t))
    return df.agg(F.avg(A.mean(square) * F.col(weight)).alias("loss"))


def step_count(rows: Column, processes: int, accumulate: int, epochs: int) -> Column:
    """Optimizer steps of a training run."""
    per_epoch = F.greatest(F.ceil(F.ceil(rows / processes) / accumulate), F.lit(1))
    return F.greatest(epochs * per_epoch, F.lit(1)).cast("bigint")


def relation_loss(student: Column, teacher: Column, margin: float = 0.1, spatial_weight: float = 1.0, temporal_weight: float = 1.0) -> Column:
    """spatial, temporal, total of two clips, each an array of frames of token vectors.

    Spatial: mean over frames and token pairs of how far the cosines differ beyond the margin.  Temporal: the
    same over pairs of different frames' mean tokens, divided by their number (1 at least).
    """
    norm = lambda clip: F.transform(clip, lambda f: F.transform(f, lambda t: A.unit(t)))
    beyond = lambda x, y: F.greatest(F.abs(x - y) - margin, F.lit(0.0))
    s, t = norm(student), norm(teacher)
    gram = lambda rows: F.transform(rows, lambda a: F.transform(rows, lambda b: A.dot(a, b)))
    flat = lambda g, h: F.flatten(F.zip_with(g, h, lambda a, b: F.zip_with(a, b, beyond)))
    spatial = A.mean(F.flatten(F.zip_with(s, t, lambda f, g: flat(gram(f), gram(g)))))
    centre = lambda clip: F.transform(clip, lambda f: A.pooled(f, F.size(f), 1)[0])
    g, h = gram(centre(s)), gram(centre(t))
    n = F.size(g)
    off = F.zip_with(F.zip_with(g, h, lambda a, b: F.zip_with(a, b, beyond)), A.ints(n), lambda row, i: A.total(row) - F.get(row, i))
    temporal = A.total(off) / F.greatest(n * (n - 1), F.lit(1))
    return F.struct(spatial.alias("spatial"), temporal.alias("temporal"), (spatial_weight * spatial + temporal_weight * temporal).alias("total"))


def probe_loss(values: Column) -> Column:
    """Mean plus a millionth of the mean square of a parameter's values."""
    return A.mean(values) + 1e-6 * A.mean(F.transform(values, lambda x: x * x))
