"""Scores of clips against the rules for background, camera, foreground, physics, reobservation, quality and freezing.

Every score is a column over one row of clip statistics (decoded once per clip): ``num_pairs`` (null or 0: no
video), ``mean_absdiff``, ``max_absdiff`` and, over more frames, ``mean_absdiff16``, ``max_absdiff16``;
``translation_total`` (null: no poses); ``blur``, ``brightness``, ``saturation``, ``flicker``; ``first_last``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import expr as E
from lumenframe.operators.manifest import REOBSERVE_WORDS

# Default weights, moving templates, and the rules that belong to a template.
WEIGHTS = {"bg": 1.0, "cam": 1.0, "fg": 1.0, "phys": 1.0, "reobs": 1.0, "quality": 0.5, "freeze": 1.0}
PARTS = ["bg", "cam", "fg", "phys", "reobs", "quality"]
MOVING = ["drop", "collision", "roll"]
RULES = {
    "drop": ["downward motion", "no floating", "no ground penetration", "no disappearance"],
    "collision": ["post-contact response", "no object fusion", "no penetration"],
    "roll": ["continuous center trajectory", "no teleport", "no unexplained jump"],
    "containment": ["stable object-container relation", "no unexplained escape"],
    "support": ["supported objects remain stable", "unsupported objects fall"],
}


def _video() -> Column:
    return F.coalesce(F.col("num_pairs") > 0, F.lit(False))


def _result(score: Column, status: Column) -> Column:
    return F.struct(score.alias("score"), status.alias("status"))


def _mean_given(*values: Column) -> Column:
    given = F.array_compact(F.array(*[v.cast("double") for v in values]))
    return F.try_divide(F.aggregate(given, F.lit(0.0), lambda a, x: a + x), F.size(given))


def background(error: Column | None = None) -> Column:
    """From a measured flow error, else from how far the largest change is above the mean one."""
    proxy = E.score_from_error(F.coalesce("max_absdiff", F.lit(0.0)) - F.coalesce("mean_absdiff", F.lit(0.0)), 0.20)
    out = F.when(_video(), _result(proxy, F.lit("proxy_frame_diff"))).otherwise(_result(F.lit(0.0), F.lit("missing_video")))
    return out if error is None else F.when(error.isNotNull(), _result(E.score_from_error(error, 2.0), F.lit("ok"))).otherwise(out)


def camera(flow: Column | None = None) -> Column:
    """How well the change between frames agrees with the camera's way."""
    way = F.col("translation_total")
    seen = F.when(_video(), F.coalesce("mean_absdiff", F.lit(0.0)))
    seen = seen if flow is None else F.coalesce(flow, seen)
    rest = E.clamp01(1 - seen / 0.08)
    moved = E.clamp01(1 - F.abs(1 - seen / (E.clamp01(way * 4) + 1e-6)))
    none = way.isNull() | seen.isNull()
    return F.when(none, _result(F.lit(0.0), F.lit("missing_camera_or_video"))).otherwise(_result(F.when(way < 1e-5, rest).otherwise(moved), F.lit("proxy_frame_diff")))


def foreground(likeness: Column | None = None, shape_change: Column | None = None) -> Column:
    """From measured likeness and change of shape, else a fixed middle where a mask is there, else from the largest change."""
    masked = F.coalesce(F.col("has_id_mask"), F.lit(False)) | (F.coalesce(F.col("id_path"), F.lit("")) != "")
    proxy = E.clamp01(1 - 0.5 * F.coalesce("max_absdiff", F.lit(0.0)))
    out = F.when(masked, _result(F.lit(0.5), F.lit("mask_available_backend_pending"))).when(_video(), _result(proxy, F.lit("global_motion_proxy"))).otherwise(
        _result(F.lit(0.0), F.lit("missing_video")))
    like, shape = (F.lit(None).cast("double") if c is None else c for c in (likeness, shape_change))
    if likeness is None and shape_change is None:
        return out
    given = F.coalesce(E.clamp01(F.when(like.isNotNull(), like)), F.lit(1.0))
    given = F.when(like.isNull(), F.lit(1.0)).otherwise(given) * F.when(shape.isNull(), F.lit(1.0)).otherwise(E.clamp01(1 - shape))
    return F.when(like.isNull() & shape.isNull(), out).otherwise(_result(given, F.lit("ok")))


def physics(pass_rate: Column | None = None) -> Column:
    """Evenness and amount of change that a template lets expect."""
    template = E.or_else(F.col("template"), F.lit("unknown"))
    mean, top = F.coalesce("mean_absdiff16", F.lit(0.0)), F.coalesce("max_absdiff16", F.lit(0.0))
    even = 1 - E.clamp01(F.greatest(F.lit(0.0), top - 4 * mean) / 0.25)
    active = F.when(template.isin(*MOVING), E.clamp01(mean / 0.015)).otherwise(E.clamp01(1 - mean / 0.20))
    known = template.isin(*RULES)
    out = F.when(~known, _result(F.when(_video(), 0.5).otherwise(0.0), F.lit("unknown_template"))).when(
        _video(), _result(E.clamp01(0.5 * even + 0.5 * active), F.lit("motion_proxy"))).otherwise(_result(F.lit(0.0), F.lit("missing_video")))
    return out if pass_rate is None else F.when(pass_rate.isNotNull(), _result(E.bare_clamp01(pass_rate), F.lit("ok"))).otherwise(out)


def reobserve(landmarks: Column | None = None, objects: Column | None = None) -> Column:
    """Likeness of what is seen before and after looking away; 1 for cameras that don't."""
    applies = E.contains_any(F.col("camera_motion"), REOBSERVE_WORDS)
    proxy = F.when(F.col("first_last").isNotNull(), _result(E.clamp01(F.col("first_last")), F.lit("first_last_proxy"))).otherwise(_result(F.lit(0.0), F.lit("missing_video")))
    given = _mean_given(*[F.lit(None).cast("double") if c is None else c for c in (landmarks, objects)])
    out = F.when(given.isNotNull(), _result(E.clamp01(given), F.lit("ok"))).otherwise(proxy)
    return F.when(~applies, _result(F.lit(1.0), F.lit("not_applicable"))).otherwise(out)


def quality(blur: Column | None = None, flicker: Column | None = None, brightness: Column | None = None) -> Column:
    """Sharpness, middle brightness, colour and steadiness; a brightness of exactly 0 counts as the middle."""
    light = F.coalesce(F.nullif(F.col("brightness"), F.lit(0.0)), F.lit(0.5))
    proxy = (E.clamp01(F.coalesce("blur", F.lit(0.0)) / 120) + (1 - F.abs(light - 0.5) * 2) + E.clamp01(F.coalesce("saturation", F.lit(0.0)) / 0.12)
             + (1 - E.clamp01(F.coalesce("flicker", F.lit(0.0)) / 0.12))) / 4
    given = _mean_given(*[F.lit(None).cast("double") if c is None else c for c in (blur, flicker, brightness)])
    out = F.when(_video(), _result(E.clamp01(proxy), F.lit("cv2_proxy"))).otherwise(_result(F.lit(0.0), F.lit("missing_video")))
    return F.when(given.isNotNull(), _result(E.clamp01(given), F.lit("ok"))).otherwise(out)


def freeze(flow: Column | None = None, foreground_flow: Column | None = None, expected_foreground: Column | None = None) -> Column:
    """Penalty and reasons for pictures that stand still where motion is due."""
    way = F.coalesce("translation_total", F.lit(0.0))
    seen = F.when(_video(), F.coalesce("mean_absdiff", F.lit(0.0)))
    seen = seen if flow is None else F.coalesce(flow, seen)
    template = F.coalesce(F.col("template"), F.lit(""))
    cam = (way > 1e-4) & (seen < 0.005)
    still = (way <= 1e-4) & (seen < 0.002) & template.isin(*MOVING)
    fg = F.lit(False)
    if foreground_flow is not None and expected_foreground is not None:
        fg = F.coalesce((expected_foreground > 1e-4) & (foreground_flow < 0.05 * expected_foreground), F.lit(False))
    penalty = F.when(seen.isNull(), 0.0).when(cam, 0.5).when(still, 0.25).otherwise(0.0) + F.when(fg, 0.5).otherwise(0.0)
    why = F.when(seen.isNull(), "missing_generated_bg_flow").when(cam, "camera_expected_but_background_nearly_static").when(still, "dynamic_template_but_video_nearly_static")
    reasons = F.array_compact(F.array(why, F.when(fg, F.lit("foreground_expected_but_nearly_static"))))
    return F.struct(E.clamp01(penalty).alias("penalty"), reasons.alias("reasons"))


def total(components: Mapping[str, Column], penalty: Column, weights: Mapping[str, float] | None = None) -> Column:
    """Weighted mean less the weighted penalty.  Negative weights count above, but not below the line."""
    w = WEIGHTS | dict(weights or {})
    under = sum(w[k] for k in PARTS if w[k] > 0) or 1.0
    return sum((F.lit(w[k]) * components[k] for k in PARTS), F.lit(0.0)) / F.lit(under) - F.lit(w["freeze"]) * penalty


def score(stats: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Reward record of each row of statistics: id, total, raw, weights, components, labels."""
    parts = {"bg": background(), "cam": camera(), "fg": foreground(), "phys": physics(), "reobs": reobserve(), "quality": quality()}
    held = stats.select("*", F.struct(*[c.alias(k) for k, c in parts.items()], freeze().alias("freeze")).alias("components"))
    raw = total({k: F.col(f"components.{k}.score") for k in PARTS}, F.col("components.freeze.penalty"), weights)
    w = F.create_map(*[F.lit(x) for kv in (WEIGHTS | dict(weights or {})).items() for x in kv])
    return held.withColumn("reward_raw", raw).select(
        "sample_id", E.clamp01(F.col("reward_raw")).alias("reward_total"), "reward_raw", w.alias("weights"), "components", "source", "template", "camera_motion")


def configured_weights(config: Mapping[str, object] | None) -> dict[str, float]:
    """Weights of a configuration: ``weights``, else ``reward_weights``, else none."""
    held = config or {}
    return dict(held.get("weights") or held.get("reward_weights") or {})


def with_candidate(df: DataFrame, column: str) -> DataFrame:
    """``df`` whose ``candidate_video_path`` is the text of ``column`` where there is any, else as it was."""
    was = F.col("candidate_video_path") if "candidate_video_path" in df.columns else F.lit(None).cast("string")
    return df.withColumn("candidate_video_path", F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), was) if column else was)


def score_batch(samples: DataFrame, stats: DataFrame, config: Mapping[str, object] | None = None, candidate_column: str = "") -> DataFrame:
    """Reward records of samples by the statistics of the video that each is scored on.

    That is the candidate's video where a sample has one, else its own; ``stats`` has ``video_path`` and the statistics that
    ``score`` reads.  A sample without statistics is scored as one without a video.
    """
    chosen = with_candidate(samples, candidate_column).withColumn("_video", E.or_else(F.col("candidate_video_path"), F.col("video_path")))
    joined = chosen.join(stats.withColumnRenamed("video_path", "_video"), "_video", "left")
    return score(joined, configured_weights(config))
