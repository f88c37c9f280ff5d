"""Queries over samples: documents stand for clips on disk, parts for their folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import expr as E
from lumenframe.operators import evaluation as V
from lumenframe.operators import manifest as M
from lumenframe.plans.registry import query, read

#: Samples of documents: other languages than English are the unknown template, short texts have quality flags.
SAMPLES_SQL = """
SELECT CAST(doc_id AS VARCHAR) AS sample_id, CASE WHEN doc_id % 7 = 0 THEN 'other' WHEN doc_id % 2 = 0 THEN 'phyinone' ELSE 'movingcam_synthetic' END AS source,
       CASE WHEN lang <> 'en' THEN 'unknown' ELSE ['drop', 'collision', 'roll', 'containment', 'support'][doc_id % 5 + 1] END AS template,
       ['orbit', 'yaw_sweep', 'static', 'offscreen_x_reobserve', 'Lookaway', 'dolly', 'reobserve'][doc_id % 7 + 1] AS camera_motion,
       CASE WHEN doc_id % 3 > 0 THEN '/clips/' || doc_id || '/video.mp4' END AS video_path,
       CASE WHEN doc_id % 4 = 0 THEN 'hdf5:///clips/' || doc_id || '.h5::camera_pose' WHEN doc_id % 4 = 1 THEN '/clips/' || doc_id || '/poses.npy' END AS poses_path,
       CASE WHEN doc_id % 5 = 0 THEN '' ELSE '/clips/' || doc_id || '/intrinsics.npy' END AS intrinsics_path,
       doc_id % 7 IN (0, 1, 5) AS has_moving_camera, doc_id % 3 = 0 AS has_depth, doc_id % 11 = 0 AS has_id_mask,
       CASE WHEN n_chars < 200 THEN ['short'] ELSE [] END AS quality_flags
FROM documents
"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), F.col("doc_id")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (i % len(v) + 1).cast("int"))
    at = lambda end: F.concat(F.lit("/clips/"), i.cast("string"), F.lit(end))
    return M.conform(d.select(
        i.cast("string").alias("sample_id"), F.when(i % 7 == 0, "other").when(i % 2 == 0, "phyinone").otherwise("movingcam_synthetic").alias("source"),
        F.when(F.col("lang") != "en", "unknown").otherwise(pick("drop", "collision", "roll", "containment", "support")).alias("template"),
        pick("orbit", "yaw_sweep", "static", "offscreen_x_reobserve", "Lookaway", "dolly", "reobserve").alias("camera_motion"),
        F.when(i % 3 > 0, at("/video.mp4")).alias("video_path"),
        F.when(i % 4 == 0, F.concat(F.lit("hdf5://"), at(".h5::camera_pose"))).when(i % 4 == 1, at("/poses.npy")).alias("poses_path"),
        F.when(i % 5 == 0, "").otherwise(at("/intrinsics.npy")).alias("intrinsics_path"), (i % 7).isin(0, 1, 5).alias("has_moving_camera"),
        (i % 3 == 0).alias("has_depth"), (i % 11 == 0).alias("has_id_mask"), F.when(F.col("n_chars") < 200, F.array(F.lit("short"))).otherwise(F.array().cast("array<string>")).alias("quality_flags")))


LABELLED_SQL = f"""
WITH s AS ({SAMPLES_SQL}), v AS (SELECT *, CAST(('0x' || substr(sha1(sample_id), 1, 8))::UBIGINT AS DOUBLE) / 4294967295.0 AS v FROM s),
l AS (SELECT sample_id, unnest(list_filter([
    CASE WHEN v < 0.05 THEN 'test' WHEN v < 0.1 THEN 'val' ELSE 'train' END,
    CASE WHEN regexp_matches(camera_motion, 'reobserve|offscreen|lookaway|yaw') THEN 'reobserve' END,
    CASE WHEN template = 'unknown' AND has_moving_camera THEN 'camera_only' END,
    CASE WHEN template <> 'unknown' AND NOT has_moving_camera THEN 'static_camera_physics' END,
    CASE WHEN template <> 'unknown' AND has_moving_camera THEN 'moving_camera_physics' END,
    CASE WHEN len(quality_flags) > 0 THEN 'stress' END], lambda x: x IS NOT NULL)) AS split FROM v)
"""


@query(LABELLED_SQL + "SELECT split, count(*) AS n FROM l GROUP BY split")
def split_counts(spark, sf_dir):
    return M.with_splits(samples(spark, sf_dir)).groupBy("split").agg(F.count("*").alias("n"))


@query(LABELLED_SQL + "SELECT sample_id, split FROM l")
def split_rows(spark, sf_dir):
    return M.with_splits(samples(spark, sf_dir)).select("sample_id", "split")


@query("SELECT p_partkey, 'phyinone_' || substr(sha1(p_type || '/' || p_name), 1, 12) AS sample_id, 'pair_' || substr(sha1(CAST(p_partkey AS VARCHAR) || 'freeze_camera'), 1, 12) AS pair_id, substr(sha256(p_name), 1, 16) AS fingerprint FROM part")
def sample_ids(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", E.stable_id(F.lit("phyinone"), F.concat_ws("/", "p_type", "p_name")).alias("sample_id"),
                    E.pair_id(F.col("p_partkey").cast("string"), F.lit("freeze_camera")).alias("pair_id"), E.fingerprint(F.col("p_name")).alias("fingerprint"))


@query(f"WITH s AS ({SAMPLES_SQL}) SELECT sample_id, source, template, camera_motion, video_path, CAST(NULL AS VARCHAR) AS hdf5_path, poses_path, true AS no_frames, has_moving_camera, has_depth, false AS has_object_state, len(quality_flags) AS n_flags FROM s")
def conform(spark, sf_dir):
    return samples(spark, sf_dir).select("sample_id", "source", "template", "camera_motion", "video_path", "hdf5_path", "poses_path", F.col("num_frames").isNull().alias("no_frames"), "has_moving_camera", "has_depth", "has_object_state", F.size("quality_flags").alias("n_flags"))


def _words_sql(column: str, rules: dict[str, list[str]]) -> str:
    arms = " ".join(f"WHEN {' OR '.join(f'''contains(lower({column}), '{k}')''' for k in keys)} THEN '{label}'" for label, keys in rules.items())
    return f"CASE {arms} ELSE 'unknown' END"


#: Parts have no words of templates, so their hashes choose a folder name.
FOLDER_SQL = "p_type || '/' || ['Fall_01', 'impactTest', 'Friction', 'Liquid', 'seesaw', 'x', 'orbit_drop', 'Return', 'PushIn', 'yaw180'][p_partkey % 10 + 1]"


@query(f"SELECT p_partkey, {_words_sql('f', M.TEMPLATE_WORDS_A)} AS template_a, {_words_sql('f', M.TEMPLATE_WORDS_B)} AS template_b, {_words_sql('f', M.CAMERA_WORDS)} AS camera FROM (SELECT p_partkey, {FOLDER_SQL} AS f FROM part)")
def first_match(spark, sf_dir):
    names = F.array(*map(F.lit, ["Fall_01", "impactTest", "Friction", "Liquid", "seesaw", "x", "orbit_drop", "Return", "PushIn", "yaw180"]))
    f = F.concat("p_type", F.lit("/"), F.element_at(names, (F.col("p_partkey") % 10 + 1).cast("int")))
    return read(spark, sf_dir, "part").select("p_partkey", E.first_match(f, M.TEMPLATE_WORDS_A).alias("template_a"), E.first_match(f, M.TEMPLATE_WORDS_B).alias("template_b"), E.first_match(f, M.CAMERA_WORDS).alias("camera"))


@query("""WITH f AS (SELECT s_nationkey AS folder, CASE s_suppkey % 9 WHEN 4 THEN 'x_Preview_' WHEN 7 THEN 'w_aligned_' ELSE '' END || s_name AS name FROM supplier)
SELECT folder, coalesce(min(CASE WHEN regexp_matches(lower(name), 'preview|aligned') THEN name END), min(name)) AS video, count(*) AS n FROM f GROUP BY 1""")
def folder_listing(spark, sf_dir):
    """A listing grouped by folder, and the video that a preference order takes."""
    name = F.concat(F.when(F.col("s_suppkey") % 9 == 4, "x_Preview_").when(F.col("s_suppkey") % 9 == 7, "w_aligned_").otherwise(""), "s_name")
    return M.folder_videos(read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("folder"), name.alias("name")))


@query(f"""WITH s AS ({SAMPLES_SQL}), n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sample_id) AS nth FROM s)
SELECT source, sample_id FROM n WHERE nth <= 25""")
def source_limit(spark, sf_dir):
    """The feature is a limit of 25 samples for each source."""
    return M.source_limit(samples(spark, sf_dir), 25).select("source", "sample_id")


def _raw(absent: str) -> Column:
    """A sample's JSON text, in which every thirteenth lacks the field ``absent``."""
    one = lambda c: F.when(F.col("sample_id").cast("long") % 13 != 0, 1) if c == absent else F.lit(1)
    return F.to_json(F.struct(*[one(c).alias(c) for c in M.schemas.SAMPLE_FIELDS]))


@query(f"""WITH s AS ({SAMPLES_SQL}), f AS (SELECT '/clips/' || doc_id || '/video.mp4' AS p FROM labels UNION ALL SELECT '/clips/' || doc_id || '/intrinsics.npy' FROM labels WHERE quality = 1),
lost AS (
  SELECT sample_id, 'missing_path:' || f AS code FROM (SELECT sample_id, unnest(['poses_path', 'video_path', 'intrinsics_path']) AS f, unnest([poses_path, video_path, intrinsics_path]) AS p FROM s)
  WHERE p IS NOT NULL AND p <> '' AND NOT starts_with(p, 'hdf5://') AND p NOT IN (SELECT p FROM f)),
e AS (SELECT sample_id, 'invalid:source' AS code FROM s WHERE source NOT IN ('phyinone', 'movingcam_synthetic') UNION ALL SELECT sample_id, 'missing:fps' FROM s WHERE CAST(sample_id AS BIGINT) % 13 = 0 UNION ALL SELECT * FROM lost)
SELECT sample_id, count(*) AS n_errors, string_agg(code, ',' ORDER BY code) AS codes FROM e GROUP BY 1""")
def validation_errors(spark, sf_dir):
    """Samples with a missing key, an unknown source or a path that the listing (files of labelled documents) hasn't."""
    marks = read(spark, sf_dir, "labels").select(F.concat(F.lit("/clips/"), F.col("doc_id").cast("string")).alias("d"), "quality")
    files = marks.select(F.concat("d", F.lit("/video.mp4")).alias("path")).unionByName(marks.filter("quality = 1").select(F.concat("d", F.lit("/intrinsics.npy")).alias("path")))
    bad = M.validation_errors(samples(spark, sf_dir).withColumn("raw", _raw("fps")), "raw", files.distinct()).filter(F.size("errors") > 0)
    return bad.select("sample_id", F.size("errors").cast("long").alias("n_errors"), F.array_join(F.array_sort("errors"), ",").alias("codes"))


#: Every thirteenth sample lacks the key of its template; an unknown template is a null.
MARGINALS_SQL = """
SELECT 'source' AS field, source AS value FROM s UNION ALL SELECT 'camera_motion', camera_motion FROM s
UNION ALL SELECT 'template', CASE WHEN CAST(sample_id AS BIGINT) % 13 = 0 THEN '{absent}' ELSE nullif(template, 'unknown') END FROM s
"""


def _with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).withColumns({"raw": _raw("template"), "template": F.nullif("template", F.lit("unknown"))})


@query(f"""WITH s AS ({SAMPLES_SQL}), m AS ({MARGINALS_SQL.format(absent="missing")}
  UNION ALL SELECT 'error', 'invalid:source' FROM s WHERE source = 'other' UNION ALL SELECT 'error', 'missing:template' FROM s WHERE CAST(sample_id AS BIGINT) % 13 = 0)
SELECT field, value, count(*) AS n FROM m GROUP BY ALL
UNION ALL SELECT 'report', 'total', count(*) FROM s UNION ALL SELECT 'report', 'bad_samples', count(*) FROM s WHERE source = 'other' OR CAST(sample_id AS BIGINT) % 13 = 0""")
def manifest_report(spark, sf_dir):
    return M.validation_report(M.validation_errors(_with_nulls(spark, sf_dir), "raw"), raw="raw")


@query(f"WITH s AS ({SAMPLES_SQL}), m AS ({MARGINALS_SQL.format(absent='unknown')}) SELECT field, value, count(*) AS n FROM m GROUP BY ALL")
def audit_marginals(spark, sf_dir):
    return M.audit_marginals(_with_nulls(spark, sf_dir), "raw")


@query(f"""WITH s AS ({SAMPLES_SQL}) SELECT count(*) AS total, CAST(count_if(has_moving_camera) AS BIGINT) AS moving_camera, CAST(count_if(coalesce(poses_path, '') <> '') AS BIGINT) AS has_pose,
 CAST(count_if(coalesce(intrinsics_path, '') <> '') AS BIGINT) AS has_intrinsics, CAST(count_if(has_depth) AS BIGINT) AS has_depth, CAST(count_if(has_id_mask) AS BIGINT) AS has_id_mask,
 CAST(count_if(regexp_matches(lower(camera_motion), 'reobserve|lookaway|offscreen|yaw')) AS BIGINT) AS reobserve_candidates FROM s""")
def audit_counts(spark, sf_dir):
    return M.camera_audit(samples(spark, sf_dir))


@query("""SELECT event_id, CASE WHEN list_contains(json_keys(props), 'k') THEN '' ELSE 'missing:k' END AS k_code, CASE WHEN list_contains(json_keys(props), 'z') THEN '' ELSE 'missing:z' END AS z_code FROM events""")
def missing_keys(spark, sf_dir):
    """Keys that the raw JSON text of an event hasn't."""
    codes = M.missing_codes(F.col("props"), ["k", "z"])
    has = lambda c: F.when(F.array_contains(codes, c), c).otherwise("")
    return read(spark, sf_dir, "events").select("event_id", has("missing:k").alias("k_code"), has("missing:z").alias("z_code"))


@query(f"""WITH s AS ({SAMPLES_SQL}) SELECT sample_id, CASE WHEN poses_path IS NULL THEN NULL WHEN starts_with(poses_path, 'hdf5://') THEN 'hdf5' ELSE 'file' END AS scheme,
 nullif(regexp_extract(poses_path, '^hdf5://(.*?)::(.*)$', 1), '') AS h5_file, nullif(regexp_extract(poses_path, '^hdf5://(.*?)::(.*)$', 2), '') AS h5_key,
 string_split(video_path, '/')[-1] AS base, string_split(video_path, '/')[-2] AS folder,
 CASE WHEN intrinsics_path = '' OR starts_with(intrinsics_path, '/') THEN intrinsics_path ELSE '/data/' || intrinsics_path END AS resolved FROM s""")
def uri_parts(spark, sf_dir):
    p, v = F.col("poses_path"), F.col("video_path")
    return samples(spark, sf_dir).select("sample_id", E.uri_scheme(p).alias("scheme"), E.hdf5_file(p).alias("h5_file"), E.hdf5_key(p).alias("h5_key"), E.base_name(v).alias("base"),
                                         F.when(v.isNotNull(), E.parent_name(v)).alias("folder"), E.resolve_path("/data", F.col("intrinsics_path")).alias("resolved"))


_EVENTS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in M.EVENT_PHRASES.items()) + "}"
_CAMERAS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in M.CAMERA_PHRASES.items()) + "}"


@query(f"""WITH s AS ({SAMPLES_SQL}) SELECT sample_id, '{M.PROMPT_SHORT}' AS p0, '{M.PROMPT_STRUCTURED}' AS p1,
 'A synthetic indoor physical scene with ' || coalesce({_EVENTS}[template], 'a physical event') || '. The static background should remain the same 3D scene while ' ||
 coalesce({_CAMERAS}[camera_motion], 'the camera follows the provided trajectory') || '. Foreground object color, shape, and identity should remain stable. The generated video must follow the provided camera poses and intrinsics.' AS p2 FROM s""")
def prompts(spark, sf_dir):
    return samples(spark, sf_dir).select("sample_id", *[M.prompt(k, F.col("template"), F.col("camera_motion")).alias(k.lower()) for k in ("P0", "P1")], M.prompt("P2", F.col("template"), F.col("camera_motion")).alias("p2"))


@query("""SELECT p_partkey, trim(replace(string_split(regexp_replace(n, '_trajectory$', ''), '__')[1], '_', ' ')) AS prompt, TRY_CAST(nullif(regexp_extract(p_brand, '(\\d+)', 1), '') AS INTEGER) AS camera FROM
(SELECT p_partkey, p_brand, replace(p_name, ' ', '_') || '__' || p_size || '_trajectory' AS n FROM part)""")
def trajectory_prompts(spark, sf_dir):
    n = F.concat(F.translate("p_name", " ", "_"), F.lit("__"), F.col("p_size").cast("string"), F.lit("_trajectory"))
    return read(spark, sf_dir, "part").select("p_partkey", E.trajectory_prompt(n).alias("prompt"), E.camera_number(F.col("p_brand")).alias("camera"))


@query("""SELECT event_id, CASE WHEN s < 0 THEN 'unknown' WHEN s >= 3600 THEN format('{}h{:02d}m', s // 3600, s % 3600 // 60) WHEN s >= 60 THEN format('{}m{:02d}s', s // 60, s % 60) ELSE format('{}s', s) END AS eta
FROM (SELECT event_id, CAST(round_even(value * (event_id % 40) - 50, 0) AS BIGINT) AS s FROM events)""")
def eta(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", E.eta_text(F.rint(F.col("value") * (F.col("event_id") % 40) - 50)).alias("eta"))


@query("""SELECT event_id, CASE WHEN isnan(v) THEN NULL ELSE v END AS number, CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0.0 ELSE v END AS filled
FROM (SELECT event_id, TRY_CAST(CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN 'inf' WHEN 3 THEN 'abc' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS v FROM events) WHERE NOT coalesce(isinf(v), false)""")
def safe_float(spark, sf_dir):
    m = F.col("event_id") % 5
    text = F.when(m == 0, "").when(m == 1, "nan").when(m == 2, "inf").when(m == 3, "abc").otherwise(F.col("event_id").cast("string"))
    v = E.safe_float(text)
    return read(spark, sf_dir, "events").select("event_id", v.alias("number"), F.when(E.finite(v), v).otherwise(0.0).alias("filled")).filter(~F.coalesce(F.col("number") == float("inf"), F.lit(False)))


@query("""SELECT event_id, coalesce(props ->> '$.fvd', props ->> '$.k') AS found, TRY_CAST(props ->> '$.k' AS DOUBLE) AS k FROM events""")
def json_fallback(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", E.json_first(F.col("props"), "$.fvd", "$.k").alias("found"), F.get_json_object("props", "$.k").try_cast("double").alias("k"))


@query("""WITH f AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1)
SELECT doc_id, CASE WHEN q = 1 AND doc_id % 3 = 0 THEN '/root/rel/' || source ELSE '/a/' || doc_id END AS picked, q IS NOT NULL AND q = 1 AND doc_id % 3 < 2 AS found FROM documents LEFT JOIN f USING (doc_id)""")
def reference_choice(spark, sf_dir):
    """The first candidate path that can be read, else the first: of good documents one in three can be read at its last candidate only, one at all, one at none."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    path, last, k = F.concat(F.lit("/a/"), F.col("doc_id").cast("string")), F.concat(F.lit("rel/"), "source"), F.col("doc_id") % 3
    good = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    d = d.join(good, "doc_id", "left").withColumn("there", F.when((F.col("q") == 1) & (k == 0), F.array(F.concat(F.lit("/root/"), last), F.lit("/b"))).when(
        (F.col("q") == 1) & (k == 1), F.array(F.concat(F.lit("/root/"), last), path)).otherwise(F.array(F.lit("/b"))))
    c = E.reference_candidates(F.lit("/root"), [path, F.when(F.col("doc_id") % 2 == 0, path), last])
    return d.select("doc_id", E.first_readable(c, F.col("there")).alias("picked"), F.arrays_overlap(c, "there").alias("found"))


@query("""SELECT p_partkey, CASE WHEN path = '' THEN 'blank' WHEN starts_with(path, 'P') THEN 'protected' WHEN p_size > 40 THEN 'high_risk' WHEN p_partkey % 3 <> 0 THEN 'missing' ELSE 'candidate' END AS decision
FROM (SELECT *, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_type END AS path FROM part)""")
def cleanup_decision(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 == 0, "").otherwise(F.col("p_type")).alias("path"), F.when(F.col("p_size") > 40, "high").otherwise("low").alias("risk"), (F.col("p_partkey") % 3 == 0).alias("exists"))
    return V.cleanup_class(p, "^P").select("p_partkey", "decision")


@query(f"""WITH s AS ({SAMPLES_SQL}) SELECT sample_id, 'v2v_prefix' AS input_mode, '{M.PROMPT_STRUCTURED}' AS prompt,
 CASE WHEN poses_path IS NULL THEN 'none' WHEN starts_with(poses_path, 'hdf5://') THEN 'extract' ELSE 'link' END AS poses, CASE WHEN intrinsics_path = '' THEN 'none' ELSE 'link' END AS intrinsics, true AS dummy_action FROM s""")
def camera_inputs(spark, sf_dir):
    return M.camera_inputs(samples(spark, sf_dir), prefix_frames=8).select("sample_id", "input_mode", "prompt", "poses", "intrinsics", "dummy_action")


@query(f"""WITH s AS ({SAMPLES_SQL}) SELECT sample_id, CASE WHEN intrinsics_path = '' THEN 'fallback_required_sam_or_flow_propagation' ELSE 'simulator_id_mask' END AS note,
 CASE WHEN contains(lower(source), 'one') THEN 'base_vs_stage2' ELSE 'base_vs_stage1' END AS folder, coalesce(CASE WHEN CAST(sample_id AS BIGINT) % 4 > 0 THEN CAST(sample_id AS BIGINT) % 4 * 10 END, 0) >= 8 AS readable,
 array_to_string((CASE CAST(sample_id AS BIGINT) % 3 WHEN 0 THEN ['0', '1', '2', '3', '4', '5', '6', '7'] WHEN 1 THEN ['2', '5', '7'] ELSE ['9'] END)[1:CASE WHEN CAST(sample_id AS BIGINT) % 4 > 0 THEN CAST(sample_id AS BIGINT) % 4 ELSE 8 END], '+') AS devices,
 CASE WHEN CAST(sample_id AS BIGINT) % 2 = 0 THEN 0.5::DOUBLE ELSE 0.75::DOUBLE END AS angle FROM s""")
def sample_notes(spark, sf_dir):
    """Small rules of a sample: where masks come from, comparison folder, readable frames, devices, camera angle."""
    i = F.col("sample_id").cast("long")
    visible = F.when(i % 3 == 1, " 2, 5,,7 ").when(i % 3 == 2, "9,")
    return samples(spark, sf_dir).select(
        "sample_id", M.mask_note(F.col("intrinsics_path")).alias("note"), E.comparison_folder(F.when(F.col("source") == "phyinone", "Stage2-x").otherwise("Stage1")).alias("folder"),
        M.readable(F.when(i % 4 > 0, i % 4 * 10), 8).alias("readable"), F.array_join(E.devices(visible, (i % 4).cast("int")), "+").alias("devices"),
        E.camera_angle(F.when(i % 2 == 0, F.lit('{"camera_angle_x": 0.5}')).otherwise("{}"), 0.75).alias("angle"))


@query(f"WITH s AS ({SAMPLES_SQL}) SELECT sample_id, source FROM s ORDER BY source, sample_id LIMIT 30")
def first_samples(spark, sf_dir):
    """The feature is a limit: the first thirty samples in order."""
    return M.first_rows(samples(spark, sf_dir), 30, "source", "sample_id").select("sample_id", "source")


@query(f"""WITH s AS ({SAMPLES_SQL}), a AS (SELECT sample_id, source FROM s WHERE source = 'phyinone'), b AS (SELECT sample_id, source FROM s WHERE source = 'movingcam_synthetic'),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sample_id) AS k FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
SELECT sample_id, source, row_number() OVER (ORDER BY source, sample_id) AS place FROM n WHERE k <= 40""")
def built_manifest(spark, sf_dir):
    """Two scans of sources joined to one manifest in order (the feature is a limit of forty for each source); places are made on the eighty rows."""
    s = samples(spark, sf_dir)
    m = M.build_manifest([s.filter("source = 'phyinone'"), s.filter("source = 'movingcam_synthetic'").drop("fps")], 40).coalesce(1)
    return m.select("sample_id", "source", (F.monotonically_increasing_id() + 1).alias("place"))


@query("""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY ('0x' || substr(sha1('7:' || doc_id), 1, 12))::BIGINT, doc_id) <= round_even(0.1 * count(*) OVER (), 0) THEN 'val' ELSE 'train' END AS split FROM documents""")
def shuffled_split(spark, sf_dir):
    """A tenth of the rows by a seeded hash, the same ones however the rows are dealt."""
    return M.shuffle_split(read(spark, sf_dir, "documents").select("doc_id").repartition(5), "doc_id", 0.1, 7)


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag, CASE WHEN p_partkey % 2 = 0 THEN 'team' END AS entity, p_brand AS project,
 CASE p_partkey % 3 WHEN 0 THEN 'blocks.w' WHEN 1 THEN 'blocks.w' ELSE 'head.w' END AS name, CASE WHEN p_size % 4 = 0 THEN '' ELSE CAST(p_size / 4.0::DOUBLE AS VARCHAR) END AS shown FROM part""")
def text_rules(spark, sf_dir):
    """Truth from words, targets, names of weights without prefixes, and rounded numbers."""
    size, k = F.col("p_size"), F.col("p_partkey")
    word = F.when(size % 3 == 0, F.when(k % 2 == 0, " Yes ").otherwise("on")).when(size % 3 == 1, F.when(k % 2 == 0, "").otherwise("OFF"))
    target = E.split_target(F.when(k % 2 == 0, F.concat(F.lit("team/"), "p_brand")).otherwise(F.col("p_brand")))
    names = E.strip_prefixes(F.create_map(F.when(k % 3 == 0, "module.blocks.w").when(k % 3 == 1, "pipe.dit.blocks.w").otherwise("head.w"), F.lit(1)), ["pipe.dit.", "module."])
    shown = E.round_or_blank(F.when(size % 4 == 0, float("nan")).otherwise(size / 4.0))
    return read(spark, sf_dir, "part").select("p_partkey", E.bool_from_text(word).alias("flag"), target["entity"].alias("entity"), target["project"].alias("project"), F.map_keys(names)[0].alias("name"), shown.alias("shown"))
