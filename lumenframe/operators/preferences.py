"""Preference pairs against synthetic negatives, their filters, calibration and losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import expr as E
from lumenframe.operators import manifest as M
from lumenframe.schemas import PAIR_FIELDS

# Kinds of corruption, those that need a mask, those that can be rendered, and the default choice for pairs.
CORRUPTIONS = [
    "background_drift", "nonrigid_background_warp", "object_deformation", "object_color_identity_change", "wrong_camera_motion",
    "camera_shuffle", "reobserve_mismatch", "freeze_foreground", "freeze_camera", "global_freeze", "remove_object",
]
MASKED = ["object_deformation", "object_color_identity_change", "freeze_foreground", "remove_object"]
RENDERED = ["freeze_camera", "global_freeze", "background_drift", "camera_shuffle", "wrong_camera_motion"]
PAIRED = ["background_drift", "wrong_camera_motion", "freeze_camera", "reobserve_mismatch"]
#: What a negative's reward is below that of its clip.
LOSS = 0.35


def corruption_table(spark: SparkSession, chosen: list[str] | None = None) -> DataFrame:
    """corruption, requires_mask, ord of the chosen kinds (all by default); unknown names are left out."""
    rows = [(c, c in MASKED, i) for i, c in enumerate(CORRUPTIONS) if chosen is None or c in chosen]
    return spark.createDataFrame(rows, "corruption string, requires_mask boolean, ord int")


def corruption_records(samples: DataFrame, out_dir: str | None = None, failed: DataFrame | None = None) -> DataFrame:
    """A row for each sample and kind of corruption, from a table of eleven rows.

    With ``out_dir`` the negative is a file there, else a URI.  ``failed`` (sample_id, corruption) names renderings
    that failed: they go back to the URI and get a flag.
    """
    out = samples.crossJoin(F.broadcast(corruption_table(samples.sparkSession).drop("ord")))  # a fixed table of eleven rows
    uri = F.concat(F.lit("corruption://"), "sample_id", F.lit("/"), "corruption")
    loser = uri
    if out_dir:
        path = F.concat(F.lit(out_dir.rstrip("/") + "/"), "sample_id", F.lit("/"), "corruption", F.lit(".mp4"))
        loser = F.when(F.coalesce(F.col("video_path"), F.lit("")) != "", path).otherwise(uri)
    flags = F.coalesce("quality_flags", F.array().cast("array<string>"))
    if failed is not None:
        out = out.join(failed.select("sample_id", "corruption", F.lit(True).alias("_failed")), ["sample_id", "corruption"], "left")
        bad = F.col("_failed") & F.col("corruption").isin(*RENDERED)
        loser = F.when(bad, uri).otherwise(loser)
        flags = F.when(bad, F.concat(flags, F.array(F.concat(F.lit("corruption_failed:"), "corruption")))).otherwise(flags)
    return out.select("sample_id", "corruption", loser.alias("loser_video"), F.col("video_path").alias("source_video"), F.lit("synthetic_negative").alias("risk"), flags.alias("quality_flags"), "requires_mask")


def pairs(rewards: DataFrame, samples: DataFrame, chosen: list[str] | None = None, min_margin: float = 0.05) -> DataFrame:
    """Preference pairs of the scored samples and the chosen corruptions whose margin is at least ``min_margin``.

    Rewards are made once per sample, whatever the number of corruptions.
    """
    optional = lambda c: F.col(c) if c in samples.columns else F.lit(None).cast("string").alias(c)
    clips = samples.select("sample_id", optional("image_path"), optional("prefix_path"), "prompt_path", "poses_path", "intrinsics_path", "video_path", "quality_flags")
    kinds = corruption_table(rewards.sparkSession, PAIRED if chosen is None else chosen).select("corruption")
    scored = rewards.select("sample_id", F.struct("reward_total", "reward_raw", "components").alias("reward")).join(clips, "sample_id").crossJoin(F.broadcast(kinds))
    clean = F.coalesce(F.col("reward.reward_total"), F.lit(0.0))
    lost = F.greatest(F.lit(0.0), clean - LOSS)
    made = scored.withColumn("margin", clean - lost).filter(F.col("margin") >= min_margin)
    loser = F.struct(F.concat(F.lit("corruption://"), "sample_id", F.lit("/"), "corruption").alias("video"), F.lit("corrupted_gt").alias("source"),
                     F.struct(lost.alias("reward_total"), F.col("reward.reward_raw").alias("reward_raw"), F.col("reward.components").alias("components"), F.col("corruption").alias("corruption")).alias("reward"))
    return made.select(
        E.pair_id(F.col("sample_id").cast("string"), F.col("corruption")).alias("pair_id"),
        F.struct(F.col("image_path").alias("image"), F.col("prefix_path").alias("prefix"), F.col("prompt_path").alias("prompt"), F.col("poses_path").alias("poses"),
                 F.col("intrinsics_path").alias("intrinsics"), F.lit(False).alias("use_action")).alias("condition"),
        F.struct(F.col("video_path").alias("video"), F.lit("clean_gt").alias("source"), F.col("reward")).alias("winner"), loser.alias("loser"),
        F.lit("gt_vs_corrupt").alias("pair_type"), "margin", F.lit(1.0).alias("weight"), F.coalesce("quality_flags", F.array().cast("array<string>")).alias("quality_flags"))


def anchored(pairs_: DataFrame, min_margin: float = 0.05, min_winner: float = 0.0, max_freeze: float = 0.6, raw: str | None = None) -> DataFrame:
    """Valid pairs fit for anchored training; missing numbers count as 0.

    With ``raw`` (the pair's JSON text) a pair is valid where ``pair_errors`` finds nothing.  Without it every field of a pair
    must be a column, and neither the fields nor the sides' videos may be null, but for the margin.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    if raw:
        valid = F.size(M.pair_errors(F.col(raw))) == 0
    elif lost := [c for c in PAIR_FIELDS if c not in pairs_.columns]:
        raise ValueError(f"pairs without {', '.join(lost)}")
    else:
        valid = F.col("winner.video").isNotNull() & F.col("loser.video").isNotNull()
        for c in PAIR_FIELDS:
            valid = valid & F.col(c).isNotNull() if c != "margin" else valid
    return pairs_.filter(valid & (zero("margin") >= min_margin) & (zero("winner.reward.reward_total") >= min_winner) & (zero("winner.reward.components.freeze.penalty") <= max_freeze))


def self_rollout(pairs_: DataFrame, min_margin: float = 0.1, min_winner_quality: float = 0.5) -> DataFrame:
    """Pairs of the model's own clips with enough margin; ``min_winner_quality`` is accepted and has no effect."""
    return pairs_.filter((F.col("pair_type") == "self_rollout") & (F.coalesce("margin", F.lit(0.0)) >= min_margin))


def calibration(scores: DataFrame) -> DataFrame:
    """corruption, n, win_rate, mean_drop: how far below their clip the corrupted ones score, and overall (corruption null).

    ``scores`` has sample_id, corruption (null: the clip itself), reward_total.  A win is a drop above 0.
    """
    clean = scores.filter("corruption IS NULL").select("sample_id", F.col("reward_total").alias("clean"))
    drops = scores.filter("corruption IS NOT NULL").join(clean, "sample_id").withColumn("drop", F.col("clean") - F.col("reward_total"))
    return drops.rollup("corruption").agg(F.count("*").alias("n"), F.avg((F.col("drop") > 0).cast("double")).alias("win_rate"), F.avg("drop").alias("mean_drop"))


def mean_reward(scores: DataFrame) -> DataFrame:
    """Mean total over all rows, null as 0; null for no rows."""
    return scores.agg(F.avg(F.coalesce("reward_total", F.lit(0.0))).alias("mean_reward"))


def log_sigmoid_loss(x: Column) -> Column:
    """-log(sigmoid(x)) without overflow."""
    return F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def dpo_loss(df: DataFrame, beta: float = 0.1) -> DataFrame:
    """Mean preference loss of policy_chosen, policy_rejected, ref_chosen, ref_rejected."""
    x = F.lit(beta) * ((F.col("policy_chosen") - F.col("policy_rejected")) - (F.col("ref_chosen") - F.col("ref_rejected")))
    return df.agg(F.avg(log_sigmoid_loss(x)).alias("loss"))


def launch_gate(stats: DataFrame, at_least: dict[str, float]) -> DataFrame:
    """The aggregate rows whose named values all reach their thresholds."""
    ok = F.lit(True)
    for c, v in at_least.items():
        ok = ok & (F.coalesce(F.col(c), F.lit(float("-inf"))) >= v)
    return stats.filter(ok)
