"""Manifests: conforming, validating, labelling, splitting and auditing samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lumenframe import schemas
from lumenframe.functions import expr as E

# Labels and the words that stand for them, first hit wins; the sources differ in their words.
TEMPLATE_WORDS_A = {
    "drop": ["drop", "verticalfall", "fall"],
    "collision": ["collision", "hit", "impact"],
    "roll": ["roll", "sliding", "friction"],
    "containment": ["contain", "container", "liquid"],
    "support": ["support", "stick", "seesaw"],
}
TEMPLATE_WORDS_B = {
    "drop": ["drop"],
    "collision": ["collision", "impact"],
    "roll": ["roll"],
    "containment": ["containment", "container"],
    "support": ["support"],
}
CAMERA_WORDS = {
    "relative_yaw_180_reobserve": ["relative_yaw_180", "yaw180"],
    "lookaway_up_reobserve": ["lookaway_up"],
    "occluder_lookaway_reobserve": ["occluder_lookaway"],
    "offscreen_z_reobserve": ["offscreen_z"],
    "offscreen_x_reobserve": ["offscreen_x"],
    "reobserve": ["reobserve", "return"],
    "orbit": ["orbit"],
    "strafe": ["strafe"],
    "dolly": ["dolly", "pushin", "pullback"],
    "static": ["static", "fixed"],
}
REOBSERVE_WORDS = ["reobserve", "offscreen", "lookaway", "yaw"]
STILL_CAMERAS = ["unknown", "static", "fixed"]

# Prompt texts.
PROMPT_SHORT = "A synthetic physical scene."
PROMPT_STRUCTURED = (
    "A synthetic indoor physical scene. The static background should remain geometrically stable. "
    "Foreground objects move under physical dynamics such as gravity, collision, rolling, containment, or support. "
    "The camera follows the provided camera trajectory."
)
PROMPT_FULL = (
    "A synthetic indoor physical scene with %s. The static background should remain the same 3D scene while %s. "
    "Foreground object color, shape, and identity should remain stable. The generated video must follow the provided camera poses and intrinsics."
)
EVENT_PHRASES = {
    "drop": "a gravity-driven drop event",
    "collision": "a collision event with object response",
    "roll": "a rolling or sliding event",
    "containment": "a containment relation between an object and a container",
    "support": "a support relation with possible support failure",
    "unknown": "a physical event",
}
CAMERA_PHRASES = {
    "lookaway_up_reobserve": "the camera looks away and later reobserves the scene",
    "occluder_lookaway_reobserve": "the camera view is partially occluded before reobserving the scene",
    "offscreen_z_reobserve": "the camera moves so the target leaves view and later returns",
    "offscreen_x_reobserve": "the camera pans sideways so the target leaves view and later returns",
    "relative_yaw_180_reobserve": "the camera yaws away and returns to reobserve the scene",
    "reobserve": "the camera leaves and returns to the scene",
    "orbit": "the camera orbits the scene",
    "strafe": "the camera strafes across the scene",
    "dolly": "the camera moves forward or backward",
    "static": "the camera remains approximately static",
    "unknown": "the camera follows the provided trajectory",
}


def conform(df: DataFrame) -> DataFrame:
    """The sample columns in order, missing ones filled with defaults, then all further columns.

    Only a missing column gets a default; a null in a column stays, but for quality_flags, which become empty.
    """
    kinds = dict(part.split(" ", 1) for part in schemas.SAMPLE_DDL.split(", "))
    have = set(df.columns)
    out = []
    for name, kind in kinds.items():
        value = F.col(name).cast(kind) if name in have else F.lit(schemas.SAMPLE_DEFAULTS.get(name)).cast(kind)
        out.append((F.coalesce(value, F.array().cast(kind)) if name == "quality_flags" else value).alias(name))
    return df.select(*out, *[F.col(f"`{c}`") for c in df.columns if c not in kinds])


def missing_codes(raw: Column, fields: list[str]) -> Column:
    """``missing:k`` for each field that isn't a key of the raw JSON text; a key with a null is there."""
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    absent = F.array_except(F.array(*[F.lit(f) for f in fields]), keys)
    return F.transform(absent, lambda k: F.concat(F.lit("missing:"), k))


def lookup_paths(df: DataFrame, key: str) -> DataFrame:
    """key, field, path of the sample paths that a file must exist for; URIs of other kinds are exempt."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("path")) for f in schemas.CHECKED_PATHS if f in df.columns])
    long = df.select(F.col(key).alias("key"), F.explode(pairs).alias("p")).select("key", "p.field", "p.path")
    return long.filter((F.coalesce(F.col("path"), F.lit("")) != "") & ~F.col("path").startswith("hdf5://") & ~F.col("path").startswith("generated://"))


def validation_errors(df: DataFrame, raw: str, files: DataFrame | None = None) -> DataFrame:
    """``df`` with ``errors``: missing keys of the raw text, an unknown source, and paths that ``files`` (path) hasn't."""
    checked = df.withColumn("_row", F.monotonically_increasing_id())
    bad_source = F.when(~F.coalesce(F.col("source").isin(*schemas.SOURCES), F.lit(False)), F.lit("invalid:source"))
    out = checked.withColumn("errors", F.concat(missing_codes(F.col(raw), schemas.SAMPLE_FIELDS), F.array_compact(F.array(bad_source))))
    if files is not None:
        lost = lookup_paths(checked, "_row").join(files.select("path"), "path", "left_anti")
        codes = lost.groupBy("key").agg(F.array_sort(F.collect_list(F.concat(F.lit("missing_path:"), "field"))).alias("lost"))
        out = out.join(codes, F.col("_row") == F.col("key"), "left").withColumn("errors", F.concat("errors", F.coalesce("lost", F.array().cast("array<string>")))).drop("key", "lost")
    return out.drop("_row")


def pair_errors(raw: Column) -> Column:
    """Error codes of a pair's raw text: missing fields, and sides without a video."""
    sides = [F.when(F.get_json_object(raw, f"$.{s}").isNotNull() & ~F.array_contains(F.coalesce(F.json_object_keys(F.get_json_object(raw, f"$.{s}")), F.array().cast("array<string>")), "video"),
                    F.lit(f"missing:{s}.video")) for s in ("winner", "loser")]
    return F.concat(missing_codes(raw, schemas.PAIR_FIELDS), F.array_compact(F.array(*sides)))


def marginals(df: DataFrame, columns: list[str], default: str, raw: str | None = None) -> DataFrame:
    """field, value, n: counts by each of the columns on its own, in one pass.

    ``default`` stands for an absent key only: a column that ``df`` hasn't or, with ``raw``, a field that isn't a
    key of the raw JSON text.  A null that is there counts as null.
    """
    have = set(df.columns)
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")) if raw else None

    def value(c: str) -> Column:
        own = F.col(c).cast("string") if c in have else F.lit(default)
        return own if keys is None else F.when(F.array_contains(keys, c), own).otherwise(F.lit(default))

    pairs = F.array(*[F.struct(F.lit(c).alias("field"), value(c).alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def validation_report(checked: DataFrame, columns: list[str] | None = None, raw: str | None = None) -> DataFrame:
    """field, value, n: totals, bad samples, error codes and marginals of validated samples; an absent key counts as ``missing``."""
    totals = checked.agg(F.count("*").alias("total"), F.count_if(F.size("errors") > 0).alias("bad_samples"))
    totals = totals.select(F.explode(F.array(*[F.struct(F.lit("report").alias("field"), F.lit(c).alias("value"), F.col(c).alias("n")) for c in ("total", "bad_samples")])).alias("p")).select("p.*")
    codes = checked.select(F.lit("error").alias("field"), F.explode("errors").alias("value")).groupBy("field", "value").agg(F.count("*").alias("n"))
    return totals.unionByName(codes).unionByName(marginals(checked, columns or ["source", "template", "camera_motion"], "missing", raw))


def camera_audit(df: DataFrame) -> DataFrame:
    """One row of counts: total, moving_camera, has_pose, has_intrinsics, has_depth, has_id_mask, reobserve_candidates."""
    there = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    low = F.lower(F.coalesce("camera_motion", F.lit("")))
    return df.agg(
        F.count("*").alias("total"), F.count_if("has_moving_camera").alias("moving_camera"), F.count_if(there("poses_path")).alias("has_pose"),
        F.count_if(there("intrinsics_path")).alias("has_intrinsics"), F.count_if("has_depth").alias("has_depth"),
        F.count_if("has_id_mask").alias("has_id_mask"), F.count_if(E.contains_any(low, REOBSERVE_WORDS)).alias("reobserve_candidates"))


def audit_marginals(df: DataFrame, raw: str | None = None) -> DataFrame:
    """field, value, n of the audit: counts by source, template and camera_motion; an absent key counts as ``unknown``."""
    return marginals(df, ["source", "template", "camera_motion"], "unknown", raw)


# The variants that an audit names.
AUDIT_VARIANTS = ["correct_camera", "frozen_camera", "wrong_camera", "shuffled_camera", "short_prompt", "structured_prompt", "i2v_first_frame", "v2v_prefix_8_16"]


def mask_note(id_path: Column) -> Column:
    """Where a background mask comes from."""
    return F.when(F.coalesce(id_path, F.lit("")) != "", "simulator_id_mask").otherwise("fallback_required_sam_or_flow_propagation")


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows by ``order``; all rows for n = 0."""
    return df.orderBy(*order).limit(n) if n else df


def readable(frames: Column, least: int = 1) -> Column:
    """Whether a clip has enough frames that can be read, one at least; null counts as none."""
    return F.coalesce(frames, F.lit(0)) >= max(1, least)


def source_limit(df: DataFrame, n: int, source: str = "source", order: str = "sample_id") -> DataFrame:
    """The first n rows of each source by ``order``; all rows for n = 0."""
    if not n:
        return df
    nth = F.row_number().over(Window.partitionBy(source).orderBy(order))
    return df.withColumn("_nth", nth).filter(F.col("_nth") <= n).drop("_nth")


def build_manifest(scans: list[DataFrame], limit: int = 0) -> DataFrame:
    """All scans conformed, at most ``limit`` rows of each source, ordered by source and id (null as empty)."""
    out = None
    for scan in scans:
        rows = source_limit(conform(scan), limit)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.orderBy(F.coalesce("source", F.lit("")), F.coalesce("sample_id", F.lit("")))


def base_split(sample_id: Column, val: float = 0.05, test: float = 0.05) -> Column:
    """``test``, ``val`` or ``train`` by the hash of the id."""
    v = E.hash_fraction(sample_id)
    return F.when(v < test, "test").when(v < test + val, "val").otherwise("train")


def semantic_labels(camera_motion: Column, template: Column, moving: Column, flags: Column) -> Column:
    """The further splits of a sample, none to three."""
    known, moves = E.or_else(template, F.lit("unknown")) != "unknown", F.coalesce(moving, F.lit(False))
    return F.array_compact(F.array(
        F.when(E.contains_any(camera_motion, REOBSERVE_WORDS), F.lit("reobserve")), F.when(~known & moves, F.lit("camera_only")),
        F.when(known & ~moves, F.lit("static_camera_physics")), F.when(known & moves, F.lit("moving_camera_physics")),
        F.when(F.size(F.coalesce(flags, F.array().cast("array<string>"))) > 0, F.lit("stress"))))


def with_splits(df: DataFrame, val: float = 0.05, test: float = 0.05) -> DataFrame:
    """A row for each split of each sample, in column ``split``."""
    labels = semantic_labels(F.col("camera_motion"), F.col("template"), F.col("has_moving_camera"), F.col("quality_flags"))
    return df.withColumn("split", F.explode(F.concat(F.array(base_split(F.col("sample_id").cast("string"), val, test)), labels)))


def shuffle_split(df: DataFrame, key: str, val_ratio: float, seed: int) -> DataFrame:
    """``df`` with ``split``: the round(n * ratio) rows that come first by a seeded hash are ``val``.

    Stands for a shuffle by another library's generator, which can't be repeated here; of equal hashes the smaller key comes first.  The cut is a hash
    threshold found by counting coarse hash buckets, then ranking within the one that the cut falls in.
    """
    h = E.seeded(F.col(key), seed)
    n = int(round(df.count() * val_ratio))
    coarse = df.select(F.shiftright(h, 36).alias("b")).groupBy("b").agg(F.count("*").alias("n")).orderBy("b").collect()  # at most 4096 rows
    seen, cut, rest = 0, -1, 0
    for row in coarse:
        if seen + row.n > n:
            cut, rest = row.b, n - seen
            break
        seen += row.n
    else:
        cut = 4096
    ranked = df.withColumn("_h", h).withColumn("_b", F.shiftright("_h", 36))
    edge = ranked.filter(F.col("_b") == cut).withColumn("_nth", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)))
    inside = edge.withColumn("split", F.when(F.col("_nth") <= rest, "val").otherwise("train")).drop("_nth")
    outside = ranked.filter(F.col("_b") != cut).withColumn("split", F.when(F.col("_b") < cut, "val").otherwise("train"))
    return outside.unionByName(inside).drop("_h", "_b")


def prompt(level: str, template: Column, camera_motion: Column) -> Column:
    """Prompt text of level P0, P1 or P2."""
    level = level.upper()
    if level == "P0":
        return F.lit(PROMPT_SHORT)
    if level == "P1":
        return F.lit(PROMPT_STRUCTURED)
    if level != "P2":
        raise ValueError(f"unknown prompt level: {level}")
    event = E.lookup(EVENT_PHRASES, E.or_else(template, F.lit("unknown")), "unknown")
    camera = E.lookup(CAMERA_PHRASES, E.or_else(camera_motion, F.lit("unknown")), "unknown")
    return F.format_string(PROMPT_FULL, event, camera)


# Words of the videos that are taken first.
LIKED_WORDS = ["preview", "aligned"]


def preferred_video(names: Column) -> Column:
    """The first name, in order, with ``preview`` or ``aligned`` in it, else the first."""
    ordered = F.array_sort(names)
    liked = F.filter(ordered, lambda v: E.contains_any(F.lower(v), LIKED_WORDS))
    return F.coalesce(F.get(liked, F.lit(0)), F.get(ordered, F.lit(0)))


def folder_videos(files: DataFrame, folder: str = "folder", name: str = "name") -> DataFrame:
    """folder, video, n: the name that ``preferred_video`` takes in each folder and how many there are, without an array of the folder."""
    liked = F.when(E.contains_any(F.lower(name), LIKED_WORDS), F.col(name))
    found = files.groupBy(folder).agg(F.min(liked).alias("liked"), F.min(name).alias("least"), F.count(name).alias("n"))
    return found.select(folder, F.coalesce("liked", "least").alias("video"), "n")


def first_existing(files: Column, folder: Column, names: list[str]) -> Column:
    """Path of the first of the names that the folder's listing has."""
    return F.coalesce(*[F.when(F.array_contains(files, n), F.concat(folder, F.lit(f"/{n}"))) for n in names])


def best_key(keys: Column, hints: list[str]) -> Column:
    """The key that equals a hint but for case, in the order of the hints, else the first that contains one."""
    def first(test: Callable[[Column, str], Column], hint: str) -> Column:
        return F.get(F.filter(keys, lambda k: test(F.lower(k), hint.lower())), F.lit(0))

    return F.coalesce(*[first(lambda k, h: k == h, h) for h in hints], *[first(lambda k, h: k.contains(h), h) for h in hints])


def quality_flags(hdf5: Column, keys_scanned: bool, poses: Column, intrinsics: Column, video: Column) -> Column:
    """Flags of a sample of the second source.  Without a key scan the usual keys are taken as there."""
    found = hdf5.isNotNull()
    return F.array_compact(F.array(
        F.when(found & F.lit(not keys_scanned), F.lit("hdf5_keys_not_scanned_fast_manifest")), F.when(found & poses.isNull() & F.lit(keys_scanned), F.lit("missing_camera_pose_key")),
        F.when(found & intrinsics.isNull() & F.lit(keys_scanned), F.lit("missing_intrinsics_key")), F.when(found & video.isNull(), F.lit("needs_video_preview_or_decode"))))


def camera_inputs(df: DataFrame, level: str = "P1", frames: int = 81, fps: int = 16, size: str = "832x480", prefix_frames: int = 0, use_action: bool = False, dummy_action: bool = True) -> DataFrame:
    """Metadata rows of converted samples: prompt, input mode, targets, and how poses and intrinsics are had."""
    given = F.col("prompt_text") if "prompt_text" in df.columns else F.lit(None).cast("string")
    how = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "none").when(F.col(c).startswith("hdf5://"), "extract").otherwise("link")
    return df.select(
        "sample_id", E.or_else(F.trim(given), prompt(level, F.col("template"), F.col("camera_motion"))).alias("prompt"), F.lit(level).alias("prompt_level"),
        F.lit("v2v_prefix" if prefix_frames > 0 else "i2v_first_frame").alias("input_mode"), F.lit(frames).alias("target_num_frames"), F.lit(fps).alias("target_fps"),
        F.lit(size).alias("target_size"), F.lit(use_action).alias("use_action"), F.lit(dummy_action and not use_action).alias("dummy_action"),
        how("poses_path").alias("poses"), how("intrinsics_path").alias("intrinsics"))
