"""Queries over clips: events of a user stand for the frames of a clip, embeddings for poses and pixels.

Fifty embeddings in order of id are a clip, so clips are small and their number grows with the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from lumenframe.functions import arrays as A
from lumenframe.operators import clips as C
from lumenframe.plans.registry import query, read


@query("""WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
w AS (SELECT user_id, n, unnest(list_distinct(list_concat(range(0, greatest(n - 16, 0) + 1, 10), [greatest(n - 16, 0)]))) AS start FROM u)
SELECT user_id AS clip, start, least(start + 15, n - 1) AS last_frame, CAST(list_sum(list_transform(range(0, 16), lambda i: least(start + i, n - 1))) AS BIGINT) AS frame_sum FROM w""")
def windows(spark, sf_dir):
    n = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("clip")).agg(F.count("*").alias("n"))
    w = C.clip_windows(n, 16, 10)
    return w.select("clip", F.col("start").cast("long"), F.try_element_at("frames", F.lit(-1)).cast("long").alias("last_frame"), F.aggregate("frames", F.lit(0).cast("long"), lambda a, x: a + x).alias("frame_sum"))


@query("""WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT user_id AS clip, i AS place, CASE WHEN i = 48 THEN n - 1 ELSE CAST(round_even(i * ((n - 1) / 48.0::DOUBLE), 0) AS BIGINT) END AS frame FROM u, range(0, 49) r(i)""")
def uniform_sample(spark, sf_dir):
    n = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("clip")).agg(F.count("*").alias("n"))
    w = C.clip_windows(n, 49, 0, "uniform")
    return w.select("clip", F.posexplode("frames").alias("place", "frame")).select("clip", F.col("place").cast("long"), F.col("frame").cast("long"))


@query("""WITH c AS (SELECT conv_id, list(length(text) ORDER BY turn) AS a FROM conversations GROUP BY 1)
SELECT conv_id, CAST(list_sum(list_concat(a, list_transform(range(0, 6), lambda i: a[-1]))[1:6]) AS BIGINT) AS total, len(list_concat(a, list_transform(range(0, 6), lambda i: a[-1]))[1:6]) AS n FROM c""")
def pad_truncate(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda s: s["n"]).alias("a"))
    six = A.pad_or_cut(F.col("a"), 6)
    return c.select("conv_id", F.aggregate(six, F.lit(0).cast("long"), lambda x, y: x + y).alias("total"), F.size(six).cast("long").alias("n"))


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").withColumns({"clip": F.floor(F.col("vec_id") / 50), "frame": F.col("vec_id") % 50})


_CLIPS = "e AS (SELECT *, vec_id // 50 AS clip FROM embeddings), f AS (SELECT clip, vec_id, embedding, lag(embedding) OVER (PARTITION BY clip ORDER BY vec_id) AS p FROM e)"


@query(f"""WITH {_CLIPS},
s AS (SELECT clip, sqrt((embedding[1]::DOUBLE - p[1]) ^ 2 + (embedding[2]::DOUBLE - p[2]) ^ 2 + (embedding[3]::DOUBLE - p[3]) ^ 2) AS step FROM f)
SELECT clip, count(*) AS num_frames, round(sum(step), 6) AS translation_total, round(avg(step), 6) AS translation_mean, sum(step) > 1e-4 AS has_moving_camera FROM s GROUP BY 1""")
def motion_stats(spark, sf_dir):
    f = _vectors(spark, sf_dir).select("clip", "frame", *[F.element_at("embedding", i + 1).cast("double").alias(a) for i, a in enumerate("xyz")])
    return C.path_length(f, "clip", "frame", ["x", "y", "z"]).withColumns({c: F.round(c, 6) for c in ("translation_total", "translation_mean")})


@query(f"""WITH {_CLIPS},
d AS (SELECT clip, list_sum(list_transform(list_zip(embedding, p), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE))) / 64 / 255 AS d FROM f WHERE p IS NOT NULL)
SELECT clip, count(*) AS num_pairs, round(avg(d), 6) AS mean_absdiff, round(max(d), 6) AS max_absdiff FROM d GROUP BY 1""")
def absdiff(spark, sf_dir):
    out = C.difference_stats(_vectors(spark, sf_dir), "clip", "frame", "embedding")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_absdiff", "max_absdiff")})


@query("""WITH f AS (SELECT user_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events)
SELECT user_id, round(avg(value), 6) AS brightness_mean, round(coalesce(avg(abs(d)), 0), 6) AS brightness_flicker FROM f GROUP BY 1""")
def flicker(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return C.flicker(e, "user_id", "at", "value").withColumns({c: F.round(c, 6) for c in ("brightness_mean", "brightness_flicker")})


@query("""WITH f AS (SELECT vec_id // 50 AS clip, count(*) AS n, arg_min(embedding, vec_id) AS a, arg_max(embedding, vec_id) AS b FROM embeddings GROUP BY 1)
SELECT clip, round(1 - list_sum(list_transform(list_zip(a, b), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE))) / 64 / 255, 6) AS similarity FROM f WHERE n >= 4""")
def first_last(spark, sf_dir):
    return C.first_last(_vectors(spark, sf_dir), "clip", "frame", "embedding").withColumn("similarity", F.round("similarity", 6))


@query("""WITH d AS (SELECT a.vec_id // 50 AS clip, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ^ 2)) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 50)
SELECT clip, round(sum(s) / (count(*) * 64), 6) AS mse, round(10 * log10(255.0 * 255.0 / (sum(s) / (count(*) * 64))), 6) AS psnr FROM d GROUP BY 1""")
def psnr(spark, sf_dir):
    """Each clip's vectors against those of the next clip, frame by frame."""
    f = _vectors(spark, sf_dir)
    return C.psnr(f, f.withColumn("clip", F.col("clip") - 1), "clip", "frame", "embedding").withColumns({c: F.round(c, 6) for c in ("mse", "psnr")})


@query("""SELECT greatest(quantile_cont(abs(l_quantity - 25), 0.95), 1e-6) AS l_quantity, greatest(quantile_cont(abs(l_discount - 0.05), 0.95), 1e-6) AS l_discount FROM lineitem""")
def action_scale(spark, sf_dir):
    a = read(spark, sf_dir, "lineitem").select((F.col("l_quantity") - 25).alias("l_quantity"), (F.col("l_discount") - 0.05).alias("l_discount"))
    return C.action_scale(a, ["l_quantity", "l_discount"])


@query("""WITH s AS (SELECT greatest(quantile_cont(abs(value - 50), 0.95), 1e-6) AS s FROM events)
SELECT event_id, round(greatest(-1, least(1, (value - 50) / s)), 6) AS value FROM events, s""")
def action_norm(spark, sf_dir):
    a = read(spark, sf_dir, "events").select("event_id", (F.col("value") - 50).alias("value"))
    return C.normalise_actions(a, C.action_scale(a, ["value"]), ["value"]).withColumn("value", F.round("value", 6))


@query("""SELECT doc_id, copy FROM documents, range(0, 3) r(copy) WHERE copy = 0 OR lang = 'en'""")
def moving_repeat(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return C.repeat_moving(d.select("doc_id", "lang"), F.col("lang") == "en", 3).select("doc_id", F.col("copy").cast("long"))


@query("SELECT r_regionkey, r_name, epoch FROM region, range(0, 4) r(epoch)")
def dataset_epochs(spark, sf_dir):
    return C.epochs(read(spark, sf_dir, "region"), 4).select("r_regionkey", "r_name", F.col("epoch").cast("long"))


@query("""WITH f AS (SELECT conv_id, turn, min(turn) OVER w AS a, max(turn) OVER w AS b, count(*) OVER w AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations WINDOW w AS (PARTITION BY conv_id))
SELECT conv_id, turn, a AS frozen, a + b - turn AS reversed, CAST(round_even((k + 1) * 480 / n * 0.04::DOUBLE, 0) AS BIGINT) AS dx FROM f""")
def corrupted_frames(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn").withColumn("width", F.lit(480))
    frozen = C.corrupt_frames(c, "global_freeze", "conv_id", "turn").select("conv_id", "turn", F.col("source_frame").alias("frozen"))
    back = C.corrupt_frames(c, "camera_shuffle", "conv_id", "turn").select("conv_id", "turn", F.col("source_frame").alias("reversed"))
    drift = C.corrupt_frames(c, "background_drift", "conv_id", "turn", "width").select("conv_id", "turn", F.col("dx").cast("long").alias("dx"))
    return frozen.join(back, ["conv_id", "turn"]).join(drift, ["conv_id", "turn"])


@query("""SELECT p_partkey, round(0.5 * 832 / tan((0.5 + p_size / 100.0::DOUBLE) / 2), 6) AS fx, 416.0::DOUBLE AS cx, 240.0::DOUBLE AS cy FROM part""")
def intrinsics(spark, sf_dir):
    k = A.intrinsics(F.lit(832), F.lit(480), 0.5 + F.col("p_size") / 100.0)
    return read(spark, sf_dir, "part").select("p_partkey", k.alias("k")).select("p_partkey", F.round("k.fx", 6).alias("fx"), "k.cx", "k.cy")


@query("""WITH p AS (SELECT vec_id // 50 AS clip, vec_id % 50 AS frame, embedding[1]::DOUBLE AS t, embedding[2]::DOUBLE AS x, embedding[3]::DOUBLE AS z FROM embeddings),
n AS (SELECT *, lead(t) OVER w - t AS dt, lead(x) OVER w - x AS dx, lead(z) OVER w - z AS dz FROM p WINDOW w AS (PARTITION BY clip ORDER BY frame)),
a AS (SELECT clip, frame, sin(t) * dx + cos(t) * dz AS forward, cos(t) * dx - sin(t) * dz AS strafe, atan2(sin(dt), cos(dt)) AS yaw FROM n)
SELECT clip, frame, round(coalesce(forward, lag(forward) OVER w, 0), 4) AS forward, round(coalesce(strafe, lag(strafe) OVER w, 0), 4) AS strafe, round(coalesce(yaw, lag(yaw) OVER w, 0), 4) AS yaw, 0.0::DOUBLE AS pitch
FROM a WINDOW w AS (PARTITION BY clip ORDER BY frame)""")
def action_deltas(spark, sf_dir):
    """Actions from each camera pose to the next: turns about the vertical and steps in the plane, in closed form in the SQL."""
    v = lambda i: F.element_at("embedding", i).cast("double")
    t, o, one = v(1), F.lit(0.0), F.lit(1.0)
    m = F.array(F.array(F.cos(t), o, F.sin(t), v(2)), F.array(o, one, o, o), F.array(-F.sin(t), o, F.cos(t), v(3)), F.array(o, o, o, one))
    out = C.pose_actions(_vectors(spark, sf_dir).select("clip", "frame", m.alias("m")))
    return out.select("clip", "frame", *[(F.round(c, 4) + 0.0).alias(c) for c in ("forward", "strafe", "yaw", "pitch")])


@query("""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), w AS (SELECT conv_id, n, unnest(list_distinct(list_concat(range(0, greatest(n - 3, 0) + 1, 2), [greatest(n - 3, 0)]))) AS a FROM c),
f AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS frame, role FROM conversations)
SELECT w.conv_id AS clip, a AS first, p AS place, f.frame, role FROM w, range(0, 3) r(p) JOIN f ON f.conv_id = w.conv_id AND f.frame = least(a + p, n - 1)""")
def window_members(spark, sf_dir):
    """The turns that each window of three takes."""
    c = read(spark, sf_dir, "conversations")
    f = c.select(F.col("conv_id").alias("clip"), (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("frame"), "role")
    w = C.clip_windows(f.groupBy("clip").agg(F.count("*").alias("n")), 3, 2)
    out = C.clip_members(w, f).join(w.select("clip", "window", F.col("start").alias("first")), ["clip", "window"])
    return out.select("clip", *[F.col(x).cast("long").alias(x) for x in ("first", "place", "frame")], "role")
