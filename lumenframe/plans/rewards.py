"""Queries over scores and preference pairs: events of a user are the statistics of a clip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lumenframe import storage
from lumenframe.operators import manifest as M
from lumenframe.operators import preferences as P
from lumenframe.operators import rewards as R
from lumenframe.plans.registry import query, read
from lumenframe.schemas import PAIR_FIELDS

STATS_SQL = """
f AS (SELECT user_id, value, lag(value) OVER w AS p, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT user_id, count(p) AS np, avg(abs(value - p)) / 2000 AS m, max(abs(value - p)) / 2000 AS x, avg(CASE WHEN k <= 16 THEN abs(value - p) END) / 2000 AS m16,
      max(CASE WHEN k <= 16 THEN abs(value - p) END) / 2000 AS x16, avg(value) AS a FROM f GROUP BY 1),
st AS (SELECT CAST(user_id AS VARCHAR) AS sample_id, CASE WHEN user_id % 10 = 9 THEN NULL ELSE np END AS np, m, x, m16, x16,
       CASE WHEN user_id % 8 = 7 THEN NULL WHEN user_id % 8 = 6 THEN 0.0 WHEN user_id % 8 = 5 THEN 0.00005 ELSE a / 1000 END AS t,
       ['drop', 'collision', 'roll', 'containment', 'support', 'unknown'][user_id % 6 + 1] AS template, ['orbit', 'yaw_x', 'static', 'reobserve'][user_id % 4 + 1] AS camera_motion,
       user_id % 5 = 0 AS masked, a AS blur, CASE WHEN user_id % 3 = 0 THEN 0.0 ELSE m * 10 END AS bright, x AS sat, m AS flick, CASE WHEN user_id % 2 = 0 THEN 1 - m END AS fl FROM g),
c AS (SELECT *, coalesce(np > 0, false) AS v FROM st),
r AS (SELECT *,
  CASE WHEN v THEN greatest(0, least(1, exp(-(x - m) / 0.2))) ELSE 0.0 END AS bg,
  CASE WHEN t IS NULL OR NOT v THEN 0.0 WHEN t < 1e-5 THEN greatest(0, least(1, 1 - m / 0.08)) ELSE greatest(0, least(1, 1 - abs(1 - m / (greatest(0, least(1, t * 4)) + 1e-6)))) END AS cam,
  CASE WHEN masked THEN 0.5 WHEN v THEN greatest(0, least(1, 1 - 0.5 * x)) ELSE 0.0 END AS fg,
  CASE WHEN template = 'unknown' THEN CASE WHEN v THEN 0.5 ELSE 0.0 END WHEN v THEN greatest(0, least(1,
    0.5 * (1 - greatest(0, least(1, greatest(0, x16 - 4 * m16) / 0.25))) + 0.5 * CASE WHEN template IN ('drop', 'collision', 'roll') THEN greatest(0, least(1, m16 / 0.015)) ELSE greatest(0, least(1, 1 - m16 / 0.20)) END)) ELSE 0.0 END AS phys,
  CASE WHEN camera_motion NOT IN ('yaw_x', 'reobserve') THEN 1.0 WHEN fl IS NOT NULL THEN greatest(0, least(1, fl)) ELSE 0.0 END AS reobs,
  CASE WHEN v THEN greatest(0, least(1, (greatest(0, least(1, blur / 120)) + (1 - abs(coalesce(nullif(bright, 0), 0.5) - 0.5) * 2) + greatest(0, least(1, sat / 0.12)) + (1 - greatest(0, least(1, flick / 0.12)))) / 4)) ELSE 0.0 END AS quality,
  CAST(CASE WHEN NOT v THEN 0.0 WHEN coalesce(t, 0) > 1e-4 AND m < 0.005 THEN 0.5 WHEN coalesce(t, 0) <= 1e-4 AND m < 0.002 AND template IN ('drop', 'collision', 'roll') THEN 0.25 ELSE 0.0 END AS DOUBLE) AS frz FROM c),
s AS (SELECT *, (bg + cam + fg + phys + reobs + 0.5 * quality) / 5.5 - frz AS raw FROM r),
z AS (SELECT *, greatest(0, least(1, raw)) AS total FROM s)
"""


def clip_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = F.abs(F.col("value") - F.lag("value").over(w))
    f = read(spark, sf_dir, "events").select("user_id", "value", d.alias("d"), F.row_number().over(w).alias("k"))
    early = F.when(F.col("k") <= 16, F.col("d"))
    g = f.groupBy("user_id").agg(F.count("d").alias("np"), (F.avg("d") / 2000).alias("m"), (F.max("d") / 2000).alias("x"), (F.avg(early) / 2000).alias("m16"), (F.max(early) / 2000).alias("x16"), F.avg("value").alias("a"))
    u = F.col("user_id")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (u % len(v) + 1).cast("int"))
    return g.select(
        u.cast("string").alias("sample_id"), F.lit("phyinone").alias("source"), pick("drop", "collision", "roll", "containment", "support", "unknown").alias("template"),
        pick("orbit", "yaw_x", "static", "reobserve").alias("camera_motion"), F.when(u % 10 != 9, F.col("np")).alias("num_pairs"), F.col("m").alias("mean_absdiff"), F.col("x").alias("max_absdiff"),
        F.col("m16").alias("mean_absdiff16"), F.col("x16").alias("max_absdiff16"), F.when(u % 8 == 6, 0.0).when(u % 8 == 5, 0.00005).when(u % 8 != 7, F.col("a") / 1000).alias("translation_total"),
        (u % 5 == 0).alias("has_id_mask"), F.lit(None).cast("string").alias("id_path"), F.col("a").alias("blur"), F.when(u % 3 == 0, 0.0).otherwise(F.col("m") * 10).alias("brightness"),
        F.col("x").alias("saturation"), F.col("m").alias("flicker"), F.when(u % 2 == 0, 1 - F.col("m")).alias("first_last"))


@query(f"WITH {STATS_SQL} SELECT sample_id, " + ", ".join(f"round({c}, 9) AS {c}" for c in ("bg", "cam", "fg", "phys", "reobs", "quality")) + ', round(frz, 9) AS "freeze"' + " FROM z")
def reward_components(spark, sf_dir):
    s = R.score(clip_stats(spark, sf_dir))
    return s.select("sample_id", *[F.round(f"components.{c}.score", 9).alias(c) for c in R.PARTS], F.round("components.freeze.penalty", 9).alias("freeze"))


@query(f"WITH {STATS_SQL} SELECT sample_id, round(total, 6) AS reward_total, round(raw, 6) AS reward_raw FROM z")
def reward_total(spark, sf_dir):
    return R.score(clip_stats(spark, sf_dir)).select("sample_id", F.round("reward_total", 6).alias("reward_total"), F.round("reward_raw", 6).alias("reward_raw"))


@query(f"WITH {STATS_SQL} SELECT sample_id, round((bg + cam + 0.5 * fg + phys + reobs - 0.5 * quality) / 4.5 - 2 * frz, 6) AS reward_raw FROM z")
def reward_weights(spark, sf_dir):
    """Weights that differ from the defaults, a negative one too."""
    return R.score(clip_stats(spark, sf_dir), {"fg": 0.5, "quality": -0.5, "freeze": 2.0}).select("sample_id", F.round("reward_raw", 6).alias("reward_raw"))


_KINDS = "[" + ", ".join(f"'{c}'" for c in P.CORRUPTIONS) + "]"
_MASKED = "[" + ", ".join(f"'{c}'" for c in P.MASKED) + "]"


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS sample_id, c AS corruption, 'corruption://' || doc_id || '/' || c AS loser_video, list_contains({_MASKED}, c) AS requires_mask FROM documents, unnest({_KINDS}) k(c)""")
def corruptions(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), F.lit("v.mp4").alias("video_path"), F.array().cast("array<string>").alias("quality_flags"))
    return P.corruption_records(d).select("sample_id", "corruption", "loser_video", "requires_mask")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and rewards are stored, as a pair takes its reward record several times."""
    st = storage.table(clip_stats(spark, sf_dir), "clip-stats")
    none = F.lit(None).cast("string")
    s = st.select("sample_id", none.alias("prompt_path"), none.alias("poses_path"), none.alias("intrinsics_path"), F.concat(F.lit("/v/"), "sample_id").alias("video_path"), F.array().cast("array<string>").alias("quality_flags"))
    return P.pairs(storage.table(R.score(st), "rewards"), s)


PAIRS_SQL = STATS_SQL + """, p AS (SELECT 'pair_' || substr(sha1(sample_id || k), 1, 12) AS pair_id, sample_id, k AS corruption, total, frz, total - greatest(0, total - 0.35) AS margin
  FROM z, unnest(['background_drift', 'wrong_camera_motion', 'freeze_camera', 'reobserve_mismatch']) u(k) WHERE total - greatest(0, total - 0.35) >= 0.05)"""


@query(f"WITH {PAIRS_SQL} SELECT pair_id, corruption, '/v/' || sample_id AS winner, 'corruption://' || sample_id || '/' || corruption AS loser, round(margin, 6) AS margin, round(greatest(0, total - 0.35), 6) AS loser_total FROM p")
def pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("pair_id", F.col("loser.reward.corruption").alias("corruption"), F.col("winner.video").alias("winner"), F.col("loser.video").alias("loser"),
                                        F.round("margin", 6).alias("margin"), F.round("loser.reward.reward_total", 6).alias("loser_total"))


@query(f"WITH {PAIRS_SQL} SELECT pair_id FROM p WHERE margin >= 0.2 AND total >= 0.45 AND frz <= 0.4 AND CAST(sample_id AS BIGINT) % 5 NOT IN (1, 3)")
def anchored_pairs(spark, sf_dir):
    """Pairs fit for training; of every five samples one's pairs lack the key of the flags, and one's the loser's video."""
    p = _pairs(spark, sf_dir)
    k = F.regexp_extract("winner.video", r"(\d+)", 1).cast("long") % 5
    keys = [F.when(k != 1, 1).alias(c) if c == "quality_flags" else F.lit(1).alias(c) for c in PAIR_FIELDS if c not in ("winner", "loser")]
    raw = F.to_json(F.struct(*keys, F.struct(F.lit("v").alias("video")).alias("winner"), F.struct(F.when(k != 3, "v").alias("video"), F.lit("s").alias("source")).alias("loser")))
    return P.anchored(p.withColumn("raw", raw), 0.2, 0.45, 0.4, "raw").select("pair_id")


@query(f"""WITH {STATS_SQL}, y AS (SELECT *, CASE WHEN CAST(sample_id AS BIGINT) % 4 = 0 THEN CAST(CAST(sample_id AS BIGINT) + 1 AS VARCHAR) ELSE sample_id END AS of FROM st)
SELECT y.sample_id, round(CASE WHEN o.np > 0 THEN greatest(0, least(1, exp(-(o.x - o.m) / 0.2))) ELSE 0.0 END, 6) AS bg, y.of AS scored FROM y LEFT JOIN st o ON o.sample_id = y.of""")
def candidate_scores(spark, sf_dir):
    """Samples of which every fourth has a candidate's video, that of the next clip; the weights come from a configuration."""
    st = storage.table(clip_stats(spark, sf_dir), "clip-stats")
    i = F.col("sample_id").cast("long")
    known = ["source", "template", "camera_motion", "has_id_mask", "id_path", "translation_total"]
    s = st.select("sample_id", *known, F.col("sample_id").alias("video_path"), F.when(i % 4 == 0, (i + 1).cast("string")).when(i % 4 == 1, "").alias("generated"))
    out = R.score_batch(s, st.withColumnRenamed("sample_id", "video_path").drop(*known), {"reward_weights": {"bg": 2.0}}, "generated")
    scored = F.when(i % 4 == 0, (i + 1).cast("string")).otherwise(F.col("sample_id"))
    return out.filter(F.col("weights")["bg"] == 2.0).select("sample_id", F.round("components.bg.score", 6).alias("bg"), scored.alias("scored"))


@query("""WITH p AS (SELECT o_orderkey, o_orderkey % 3 = 0 AS a, o_orderkey % 4 = 0 AS b FROM orders)
SELECT o_orderkey, CASE WHEN a THEN 'missing:margin' ELSE '' END || CASE WHEN a AND b THEN ',' ELSE '' END || CASE WHEN b THEN 'missing:winner.video' ELSE '' END AS errors FROM p""")
def pair_errors(spark, sf_dir):
    """What the raw texts of pairs lack."""
    k = F.col("o_orderkey")
    keys = [F.when(k % 3 != 0, 1).alias(c) if c == "margin" else F.lit(1).alias(c) for c in PAIR_FIELDS if c not in ("winner", "loser")]
    raw = F.to_json(F.struct(*keys, F.struct(F.when(k % 4 != 0, "v").alias("video"), F.lit("s").alias("source")).alias("winner"), F.struct(F.lit("v").alias("video")).alias("loser")))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(M.pair_errors(raw), ",").alias("errors"))


@query("SELECT o_orderkey AS pair_id FROM orders WHERE o_orderstatus = 'F' AND o_totalprice / 100000 >= 0.1")
def self_rollout(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair_id"), F.when(F.col("o_orderstatus") == "F", "self_rollout").otherwise("gt_vs_corrupt").alias("pair_type"), (F.col("o_totalprice") / 100000).alias("margin"))
    return P.self_rollout(o).select("pair_id")


@query("""WITH c AS (SELECT l_orderkey, l_extendedprice AS clean FROM lineitem WHERE l_linenumber = 1),
d AS (SELECT l_shipmode, clean - l_extendedprice AS d FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS l_shipmode, l_extendedprice FROM lineitem WHERE l_linenumber > 1) JOIN c USING (l_orderkey))
SELECT l_shipmode AS corruption, count(*) AS n, round(avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(avg(d), 2) AS mean_drop FROM d GROUP BY ROLLUP (l_shipmode)""")
def calibration(spark, sf_dir):
    """Each order's first line against its other ones."""
    line = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.when(F.col("l_linenumber") > 1, F.concat("l_returnflag", "l_linestatus")).alias("corruption"), F.col("l_extendedprice").alias("reward_total"))
    return P.calibration(line).select("corruption", "n", F.round("win_rate", 6).alias("win_rate"), F.round("mean_drop", 2).alias("mean_drop"))


@query("SELECT round(avg(coalesce(CASE WHEN event_id % 7 > 0 THEN value END, 0)), 6) AS mean_reward FROM events")
def mean_reward(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 > 0, F.col("value")).alias("reward_total"))
    return P.mean_reward(e).select(F.round("mean_reward", 6).alias("mean_reward"))


@query("SELECT round(avg(ln(1 + exp(-0.1 * ((l_quantity - l_linenumber) - (l_discount - l_tax) * 100)))), 6) AS loss FROM lineitem")
def dpo_loss(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("policy_chosen"), F.col("l_linenumber").alias("policy_rejected"), (F.col("l_discount") * 100).alias("ref_chosen"), (F.col("l_tax") * 100).alias("ref_rejected"))
    return P.dpo_loss(x).select(F.round("loss", 6).alias("loss"))


@query("SELECT l_suppkey, count(*) AS n, round(avg(l_quantity), 6) AS margin FROM lineitem GROUP BY 1 HAVING count(*) >= 550 AND round(avg(l_quantity), 6) >= 25")
def launch_gate(spark, sf_dir):
    g = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("margin"))
    return P.launch_gate(g, {"n": 550, "margin": 25.0})
