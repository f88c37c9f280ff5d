"""Queries over cameras, picture sizes and tokens: embeddings hold the coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import arrays as A
from lumenframe.operators import clips as C
from lumenframe.operators import training as T
from lumenframe.plans.registry import query, read
from lumenframe.sources import readers as S

_DRAWN = "g AS (SELECT vec_id // 20 AS zip, vec_id % 20 AS grp, vec_id % 5 = 0 AS red, embedding::DOUBLE[] AS e FROM embeddings)"
_AWAY = ", ".join(f"list_transform([1, 2, 3], lambda i: e[{3 * p} + i] - e[i]) AS {name}" for p, name in ((6, "a"), (7, "h"), (8, "b")))
_CROSS = "[{0}[2] * {1}[3] - {0}[3] * {1}[2], {0}[3] * {1}[1] - {0}[1] * {1}[3], {0}[1] * {1}[2] - {0}[2] * {1}[1]]"
_UNIT = "list_transform({0}, lambda v: v / sqrt(list_dot_product({0}, {0})))"


@query(f"""WITH {_DRAWN}, d AS (SELECT zip, row_number() OVER (PARTITION BY zip ORDER BY grp) - 1 AS k, e, {_AWAY} FROM g WHERE NOT red),
x AS (SELECT *, {_UNIT.format('a')} AS x FROM d), y AS (SELECT *, list_transform([1, 2, 3], lambda i: h[i] - list_dot_product(h, x) * x[i]) AS q FROM x), u AS (SELECT *, {_UNIT.format('q')} AS y FROM y),
z AS (SELECT *, {_CROSS.format('x', 'y')} AS w FROM u), s AS (SELECT *, CASE WHEN -list_dot_product(w, b) < 0 THEN -1 ELSE 1 END AS side FROM z),
t AS (SELECT *, list_transform(w, lambda v: v * side) AS z FROM s), r AS (SELECT *, {_CROSS.format('z', 'x')} AS v FROM t)
SELECT zip, 'CineCamera_' || k AS camera, {', '.join(f'round({c}[{i}], 4) AS {c}{i}' for c in ('x', 'v', 'z') for i in (1, 2, 3))}, round(e[1], 4) AS c1, round(e[2], 4) AS c2, round(e[3], 4) AS c3 FROM r""")
def camera_poses(spark, sf_dir):
    """Poses of the cameras of archives (twenty drawn ones each, every fifth of them red) by the order of their numbers."""
    e = read(spark, sf_dir, "embeddings").withColumns({"zip": F.floor(F.col("vec_id") / 20), "camera": F.col("vec_id") % 20})
    rows = e.select("zip", "camera", "vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("point"))
    points = rows.select("zip", "camera", "point", *[F.get("embedding", F.col("point") * 3 + i).alias(c) for i, c in enumerate("xyz")],
                         F.lit(255).alias("r"), *[F.when(F.col("vec_id") % 5 == 0, 0).otherwise(9).alias(c) for c in "gb"])
    fixed = e.filter("vec_id % 5 <> 0").groupBy("zip").agg(F.count("*").cast("int").alias("n"))
    names = fixed.select("zip", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")).select("zip", F.concat(F.lit("CineCamera_"), F.col("k").cast("string")).alias("camera"))
    m = C.camera_poses(points, names, "zip")
    at = lambda i, j: (F.round(F.get(F.get("m", F.lit(i)), F.lit(j)), 4) + 0.0)
    return m.select("zip", "camera", *[at(i, j).alias(f"{c}{i + 1}") for j, c in enumerate(("x", "v", "z", "c")) for i in range(3)])


_NAMES = "n AS (SELECT o_custkey AS zip, 'CineCamera_' || (o_orderkey % 12) AS camera FROM orders)"


@query(f"""WITH {_NAMES} SELECT DISTINCT zip, camera, 'chosen' AS kind FROM n WHERE camera IN ('CineCamera_3', 'CineCamera_7', 'CineCamera_11')
UNION ALL SELECT z.zip, c.camera, 'absent' FROM (SELECT DISTINCT zip FROM n) z, (VALUES ('CineCamera_3'), ('CineCamera_7'), ('CineCamera_11')) c(camera) WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.zip = z.zip AND n.camera = c.camera)
UNION ALL SELECT zip, CAST(count(DISTINCT camera) AS VARCHAR), 'all' FROM n GROUP BY zip""")
def camera_choice(spark, sf_dir):
    """Cameras (orders) of archives (customers) that a list names, those that it names in vain, and how many there are."""
    n = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("zip"), F.concat(F.lit("CineCamera_"), (F.col("o_orderkey") % 12).cast("string")).alias("camera"))
    spec = " 3, CineCamera_7,11, "
    every = C.chosen_cameras(n, " All ").groupBy("zip").agg(F.count("*").cast("string").alias("camera"))
    kinds = (("chosen", C.chosen_cameras(n, spec)), ("absent", C.absent_cameras(n, spec)), ("all", every))
    out = [d.select("zip", "camera", F.lit(k).alias("kind")) for k, d in kinds]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""WITH f AS (SELECT conv_id AS zip, list(turn ORDER BY turn) AS m FROM conversations GROUP BY 1), c AS (SELECT zip, 'cam' || k AS camera, m, len(m) AS n FROM f, range(0, 2) r(k)),
w AS (SELECT zip, camera, m, n, unnest(list_distinct(list_concat(range(0, greatest(n - 3, 0) + 1, 2), [greatest(n - 3, 0)]))) AS a FROM c)
SELECT zip, camera, a AS window_start_frame, least(a + 2, n - 1) AS window_end_frame, n AS raw_frame_count, array_to_string(list_transform(range(0, 3), lambda i: CAST(m[least(a + i, n - 1) + 1] AS VARCHAR)), ',') AS members FROM w""")
def archive_clips(spark, sf_dir):
    """Windows of three turns of two cameras for each conversation."""
    turns = F.transform(F.array_sort(F.collect_list("turn")), lambda t: t.cast("string"))
    f = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("zip")).agg(turns.alias("frames"))
    cameras = f.withColumn("camera", F.explode(F.array(F.lit("cam0"), F.lit("cam1"))))
    out = C.archive_clips(cameras, 3, 2)
    return out.select("zip", "camera", *[F.col(c).cast("long").alias(c) for c in ("window_start_frame", "window_end_frame", "raw_frame_count")], F.array_join("members", ",").alias("members"))


@query("""SELECT CASE WHEN c.c_custkey % 20 = 0 THEN 'val' ELSE 'train' END AS split, count(DISTINCT o_custkey) AS archives, count(*) AS clips, count(DISTINCT o_orderdate::DATE) AS unique_clips,
 CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS moving, CAST(count_if(o_orderpriority LIKE '1%') AS BIGINT) AS static FROM orders JOIN customer c ON c_custkey = o_custkey GROUP BY 1""")
def clip_counts(spark, sf_dir):
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    clips = o.select(F.when(F.col("c_custkey") % 20 == 0, "val").otherwise("train").alias("split"), F.col("o_custkey").alias("source_zip"), F.col("o_orderdate").cast("date").alias("clip_path"),
                     F.when(F.col("o_orderstatus") == "F", "CineCamera_Moving").otherwise("CineCamera_1").alias("camera_id"),
                     F.when(F.col("o_orderpriority").startswith("1"), "static_camera_zero").otherwise("moving_camera_pose_delta").alias("action_source"))
    return C.clip_counts(clips, "CineCamera_Moving")


@query("""WITH s AS (SELECT p_partkey, p_size * 16 AS w, (p_size % 7 + 1) * 90 AS h FROM part),
l AS (SELECT *, least(832.0::DOUBLE / w, 480.0::DOUBLE / h) AS k, 256.0::DOUBLE / least(w, h) AS c FROM s),
b AS (SELECT *, CAST(greatest(round_even(w * k, 0), 1) AS INTEGER) AS bw, CAST(greatest(round_even(h * k, 0), 1) AS INTEGER) AS bh, CAST(round_even(w * c, 0) AS INTEGER) AS cw, CAST(round_even(h * c, 0) AS INTEGER) AS ch FROM l)
SELECT p_partkey, bw, bh, CAST(floor((832 - bw) / 2.0) AS INTEGER) AS bx, CAST(floor((480 - bh) / 2.0) AS INTEGER) AS "by", cw, ch, CAST(floor((cw - 256) / 2.0) AS INTEGER) AS cx, CAST(floor((ch - 256) / 2.0) AS INTEGER) AS cy,
 CAST(p_partkey % 5 + 1 AS INTEGER) AS t, CAST(h // 30 AS INTEGER) AS th, CAST(w // 16 AS INTEGER) AS tw FROM b""")
def picture_sizes(spark, sf_dir):
    """A picture fitted into a box, cut to a square, and the grid of its tokens."""
    p = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 16).alias("w"), ((F.col("p_size") % 7 + 1) * 90).alias("h"))
    box, cut = A.letterbox(F.col("w"), F.col("h"), 832, 480), A.centre_crop(F.col("w"), F.col("h"), 256)
    n = (F.col("p_partkey") % 5 + 1).cast("int")
    p = p.withColumns({"b": box, "c": cut, "g": A.token_grid(n * 2, F.floor(F.col("h") / 30).cast("int") * 2, F.floor(F.col("w") / 16).cast("int") * 2, 2, 2)})
    return p.select("p_partkey", F.col("b.width").alias("bw"), F.col("b.height").alias("bh"), F.col("b.left").alias("bx"), F.col("b.top").alias("by"), F.col("c.width").alias("cw"), F.col("c.height").alias("ch"),
                    F.col("c.left").alias("cx"), F.col("c.top").alias("cy"), "g.t", F.col("g.h").alias("th"), F.col("g.w").alias("tw"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / 127.5 - 1)), 5) AS signed, round(list_sum(list_transform(e, lambda x: (x + 1) / 2)), 5) AS unit, round(list_sum(e) * 3, 5) AS thrice, 48::BIGINT AS actions,
 CAST(list_sum(list_transform(range(0, 8), lambda i: round_even(i * 62.0::DOUBLE / 7, 0) + 1)) AS BIGINT) AS dropped_before, CAST(list_sum(list_transform(range(1, 8), lambda i: round_even(i * 63.0::DOUBLE / 7, 0))) AS BIGINT) AS dropped_after FROM v""")
def pixel_values(spark, sf_dir):
    """Values scaled both ways, a vector repeated, actions of zero, and frames sampled without the first."""
    e, n = F.col("embedding"), F.size("embedding")
    total = lambda c: F.round(A.total(c), 5)
    frames = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return read(spark, sf_dir, "embeddings").select(
        "vec_id", total(A.signed_pixels(e)).alias("signed"), total(A.unit_pixels(e)).alias("unit"), total(F.flatten(A.repeated(e, 3))).alias("thrice"),
        F.size(F.flatten(A.zero_actions(F.lit(12)))).cast("long").alias("actions"), frames(A.sampled_without_first(n, 8, True)).alias("dropped_before"), frames(A.sampled_without_first(n, 8, False)).alias("dropped_after"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), t AS (SELECT vec_id, [e[1:8], e[9:16], e[17:24], e[25:32], e[33:40]] AS t FROM v),
p AS (SELECT vec_id, t, list_transform([[1, 2], [2, 4], [4, 5]], lambda b: list_transform(range(1, 9), lambda i: list_sum(list_transform(range(b[1], b[2] + 1), lambda k: t[k][i])) / (b[2] - b[1] + 1))) AS q FROM t)
SELECT vec_id, round(q[1][1], 6) AS first, round(q[2][5], 6) AS middle, round(q[3][8], 6) AS last, round(list_cosine_similarity(t[1], t[3]), 6) AS relation, round(list_sum(e2) / 8 + 1e-6 * list_sum(list_transform(e2, lambda x: x * x)) / 8, 6) AS probe
FROM (SELECT *, t[2] AS e2 FROM p)""")
def token_pools(spark, sf_dir):
    """Five tokens of eight values pooled to three, one relation of the matrix, and a probe loss."""
    t = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.slice("embedding", k * 8 + 1, 8))
    v = read(spark, sf_dir, "embeddings").select("vec_id", t.alias("t"))
    q = A.pooled(F.col("t"), F.lit(5), 3)
    at = lambda m, i, j: F.round(F.get(F.get(m, F.lit(i)), F.lit(j)), 6)
    return v.select("vec_id", at(q, 0, 0).alias("first"), at(q, 1, 4).alias("middle"), at(q, 2, 7).alias("last"), at(A.relation_matrix(F.col("t")), 0, 2).alias("relation"),
                    F.round(T.probe_loss(F.get("t", F.lit(1))), 6).alias("probe"))


@query("""SELECT vec_id, i // 9 AS camera, i % 9 AS point, round(embedding[i + 1]::DOUBLE, 4) AS x, round(embedding[i + 2]::DOUBLE, 4) AS y, round(embedding[i + 3]::DOUBLE, 4) AS z, CASE WHEN i < 9 THEN 255 ELSE 7 END AS r FROM embeddings, range(0, 18) p(i)""")
def drawn_points(spark, sf_dir):
    """The points of ASCII PLY texts with two drawn cameras each."""
    at = lambda i: F.format_string("%.4f", F.get("embedding", i).cast("double"))
    line = F.transform(F.sequence(F.lit(0), F.lit(17)), lambda i: F.concat_ws(" ", at(i), at(i + 1), at(i + 2), F.when(i < 9, "255").otherwise("7"), F.lit("0 0")))
    text = F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex 18\nend_header\n"), F.array_join(line, "\n"), F.lit("\n"))
    p = S.ply_points(read(spark, sf_dir, "embeddings").select("vec_id", text.alias("text")), "vec_id", "text")
    return p.select("vec_id", F.col("camera").cast("long"), F.col("point").cast("long"), *[(F.round(c, 4) + 0.0).alias(c) for c in "xyz"], F.col("r").cast("int"))


@query("""SELECT vec_id, frame, round(embedding[frame + 1]::DOUBLE, 4) AS x, 1.0::DOUBLE AS one FROM embeddings, range(0, 3) f(frame)""")
def pose_records(spark, sf_dir):
    """Poses of camera JSON texts whose frames stand in reverse order."""
    v = lambda i: F.format_string("%.4f", F.get("embedding", F.lit(i)).cast("double"))
    frame = lambda i: F.concat(F.lit(f'{{"frame": {i}, "transform_matrix": [[1,0,0,'), v(i), F.lit("],[0,1,0,0],[0,0,1,0],[0,0,0,1]]}"))
    text = F.concat(F.lit('{"frames": ['), F.concat_ws(",", frame(2), frame(1), frame(0)), F.lit("]}"))
    rows = S.camera_frames(read(spark, sf_dir, "embeddings").select("vec_id", text.alias("text")), "vec_id", "text")
    at = lambda i, j: F.get(F.get("m", F.lit(i)), F.lit(j))
    return rows.select("vec_id", F.col("frame").cast("long").alias("frame"), (F.round(at(0, 3), 4) + 0.0).alias("x"), at(3, 3).alias("one"))


_TOKENS = "[[{0}[1:16], {0}[17:32]], [{0}[33:48], {0}[49:64]]]"
_COS = "list_cosine_similarity({0}[{1}][{2}], {0}[{1}][{3}])"
_SPATIAL = " + ".join(f"greatest(abs({_COS.format('s', f, i, j)} - {_COS.format('t', f, i, j)}) - 0.1, 0)" for f in (1, 2) for i in (1, 2) for j in (1, 2))
_CENTRE = "list_transform(range(1, 17), lambda i: ({0}[{1}][1][i] / sqrt(list_dot_product({0}[{1}][1], {0}[{1}][1])) + {0}[{1}][2][i] / sqrt(list_dot_product({0}[{1}][2], {0}[{1}][2]))) / 2)"


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS a, list_reverse(embedding::DOUBLE[]) AS b FROM embeddings), c AS (SELECT vec_id, {_TOKENS.format('a')} AS s, {_TOKENS.format('b')} AS t FROM v),
m AS (SELECT *, list_dot_product({_CENTRE.format('s', 1)}, {_CENTRE.format('s', 2)}) AS x, list_dot_product({_CENTRE.format('t', 1)}, {_CENTRE.format('t', 2)}) AS y FROM c)
SELECT vec_id, round(({_SPATIAL}) / 8, 6) AS spatial, round(greatest(abs(x - y) - 0.1, 0), 6) AS temporal FROM m""")
def relation_losses(spark, sf_dir):
    """Spatial and temporal relation losses of two frames of two tokens against those of the reversed vector."""
    e = F.col("embedding")
    clip = lambda c: F.array(*[F.array(*[F.slice(c, 32 * f + 16 * k + 1, 16) for k in (0, 1)]) for f in (0, 1)])
    out = read(spark, sf_dir, "embeddings").select("vec_id", clip(e).alias("s"), clip(F.reverse(e)).alias("t")).withColumn("l", T.relation_loss(F.col("s"), F.col("t")))
    return out.select("vec_id", F.round("l.spatial", 6).alias("spatial"), F.round("l.temporal", 6).alias("temporal"))


@query("""WITH s AS (SELECT i AS idx, 10.0::DOUBLE * (1 - i / 1000.0::DOUBLE) / (1 + 9 * (1 - i / 1000.0::DOUBLE)) AS sigma FROM range(0, 1000) r(i)),
low AS (SELECT idx, sigma, row_number() OVER (ORDER BY idx) - 1 AS k, count(*) OVER () AS n FROM s WHERE sigma * 1000 < 947)
SELECT vec_id, CAST(idx AS INTEGER) AS idx, round(sigma, 9) AS sigma FROM embeddings JOIN low ON k = ('0x' || substr(sha1('5:' || vec_id), 1, 12))::BIGINT % n""")
def drawn_timesteps(spark, sf_dir):
    """A step of the low branch drawn for each row by its key, however the rows are dealt."""
    e = read(spark, sf_dir, "embeddings").select("vec_id")
    return T.sample_timesteps(e.repartition(5), T.noise_schedule(spark), "low", 5, "vec_id").select("vec_id", "idx", F.round("sigma", 9).alias("sigma"))
