"""Queries that write files from the tables and read them back, and queries over listings of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe import schemas, storage
from lumenframe.operators import evaluation as V
from lumenframe.operators import manifest as M
from lumenframe.plans.manifest import LABELLED_SQL, SAMPLES_SQL, samples
from lumenframe.plans.registry import query, read
from lumenframe.sources import readers as S
from lumenframe.sources import writers as K
from lumenframe.streaming import progress as P


@query(f"""WITH s AS ({SAMPLES_SQL}) SELECT sample_id, source, template, poses_path, has_depth, len(quality_flags) AS n_flags, (SELECT count(*) FROM s) AS written FROM s""")
def manifest_file(spark, sf_dir):
    """A manifest as JSON lines, written and read with its schema."""
    path = storage.new_path(spark, "manifest")
    n = K.write_jsonl(samples(spark, sf_dir), path)
    return S.read_jsonl(spark, path).select("sample_id", "source", "template", "poses_path", "has_depth", F.size("quality_flags").alias("n_flags"), F.lit(n).cast("long").alias("written"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, nullif(p_name, '') AS p_name, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'a,"' || p_brand || '"' END AS note, (SELECT count(*) FROM part) AS written FROM part""")
def table_file(spark, sf_dir):
    """A CSV file with commas, quotes and empty cells, written and read as text."""
    path = storage.new_path(spark, "table")
    note = F.when(F.col("p_size") % 3 != 0, F.concat(F.lit('a,"'), "p_brand", F.lit('"')))
    n = K.write_csv_rows(read(spark, sf_dir, "part").withColumn("note", note), path, ["note", "p_partkey", "p_name"])
    return S.read_csv_rows(spark, path, ["note", "p_partkey", "p_name"]).select("p_partkey", "p_name", "note", F.lit(n).cast("long").alias("written"))


@query(LABELLED_SQL + "SELECT split, count(*) AS n, count(*) AS said FROM l GROUP BY split")
def split_files(spark, sf_dir):
    """A folder for each split; rows read back beside the numbers that the writer gave."""
    path = storage.new_path(spark, "splits")
    said = K.write_splits(M.with_splits(samples(spark, sf_dir)).select("sample_id", "split"), path)
    back = spark.read.schema("sample_id string, split string").json(path).groupBy("split").agg(F.count("sample_id").alias("n"))
    return back.join(spark.createDataFrame(list(said.items()), "split string, said long"), "split", "left")


@query("""SELECT p_type || '/' || p_partkey AS path, CAST(p_size AS VARCHAR) AS size_gb, CASE WHEN p_size > 40 THEN 'high' ELSE 'low' END AS risk FROM part WHERE p_partkey % 9 > 0""")
def cleanup_file(spark, sf_dir):
    """A tab-separated file of cleanup candidates; rows without a path go."""
    path = storage.new_path(spark, "cleanup")
    p = read(spark, sf_dir, "part")
    rows = p.select(F.when(F.col("p_partkey") % 9 > 0, F.concat("p_type", F.lit("/"), F.col("p_partkey").cast("string"))).otherwise("").alias("path"), F.col("p_size").cast("string").alias("size_gb"), F.lit("dir").alias("type"),
                    F.lit("old").alias("reason"), F.when(F.col("p_size") > 40, "high").otherwise("low").alias("risk"), F.lit("keep").alias("action"))
    rows.write.option("header", True).option("sep", "\t").csv(path)
    return S.read_cleanup(spark, path).select("path", "size_gb", "risk")


#: Files of the folders of parts; every folder has a video, and some have sidecars.
LISTING_SQL = """
p AS (SELECT p_partkey AS k, '/data/' || replace(p_type, ' ', '_') || '/' || ['Fall', 'impact', 'Friction', 'static', 'x'][p_partkey % 5 + 1] || '_' || p_partkey AS d FROM part),
l AS (SELECT d, unnest(list_filter(['video.mp4', CASE WHEN k % 2 = 0 THEN 'depth.npy' END, CASE WHEN k % 3 = 0 THEN 'mask.npy' END, CASE WHEN k % 4 = 0 THEN 'poses.npy' END, CASE WHEN k % 6 = 0 THEN 'prompt.txt' END, CASE WHEN k % 7 = 0 THEN 'states.json' END], lambda x: x IS NOT NULL)) AS f FROM p)
"""


def _listing(spark, sf_dir):
    k = F.col("p_partkey")
    word = F.element_at(F.array(*map(F.lit, ["Fall", "impact", "Friction", "static", "x"])), (k % 5 + 1).cast("int"))
    d = F.concat(F.lit("/data/"), F.translate("p_type", " ", "_"), F.lit("/"), word, F.lit("_"), k.cast("string"))
    some = [F.lit("video.mp4"), *[F.when(k % n == 0, f) for n, f in ((2, "depth.npy"), (3, "mask.npy"), (4, "poses.npy"), (6, "prompt.txt"), (7, "states.json"))]]
    files = read(spark, sf_dir, "part").select(d.alias("folder"), F.explode(F.array_compact(F.array(*some))).alias("name"))
    return files.withColumn("path", F.concat_ws("/", "folder", "name"))


def _picked(column: str, *names: str) -> str:
    return f"CASE {' '.join(f'''WHEN list_contains(f, '{n}') THEN d || '/{n}' ''' for n in names)} END AS {column}"


@query(f"""WITH {LISTING_SQL}, g AS (SELECT d, list(f) AS f FROM l GROUP BY d)
SELECT 'phyinone_' || substr(sha1(d), 1, 12) AS sample_id, CASE WHEN contains(lower(d), 'fall') THEN 'drop' WHEN contains(lower(d), 'impact') THEN 'collision' WHEN contains(lower(d), 'friction') THEN 'roll' ELSE 'unknown' END AS template,
 CASE WHEN contains(lower(d), 'static') THEN 'static' ELSE 'unknown' END AS camera_motion, {_picked('depth_path', 'depth.npy')}, {_picked('id_path', 'mask.npy')}, {_picked('poses_path', 'poses.npy')},
 CASE WHEN list_contains(f, 'prompt.txt') THEN d || '/prompt.txt' ELSE 'generated://phyinone' END AS prompt_path, list_contains(f, 'states.json') AS has_object_state, coalesce(list_contains(f, 'poses.npy') AND len(d) % 2 = 0, false) AS has_moving_camera FROM g""")
def clip_scan(spark, sf_dir):
    """Samples of the first source from a listing; poses of folders with names of even length move."""
    files = _listing(spark, sf_dir)
    moving = files.filter("name = 'poses.npy'").select(F.col("path").alias("poses_path"), (F.length("folder") % 2 == 0).alias("has_moving_camera"))
    return S.scan_clips(files, moving).select("sample_id", "template", "camera_motion", "depth_path", "id_path", "poses_path", "prompt_path", "has_object_state", "has_moving_camera")


@query("""WITH p AS (SELECT s_suppkey AS k, '/cap/' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '_orbit' ELSE '_containment' END AS d FROM supplier),
m AS (SELECT *, k % 3 > 0 AS h5, k % 4 > 0 AS video, k % 5 = 0 AS meta FROM p)
SELECT 'movingcam_synthetic_' || substr(sha1(d), 1, 12) AS sample_id, CASE WHEN meta THEN 'trial' WHEN k % 2 = 1 THEN 'containment' ELSE 'unknown' END AS template, CASE WHEN meta THEN 'dolly' WHEN k % 2 = 0 THEN 'orbit' ELSE 'unknown' END AS camera_motion,
 CASE WHEN video THEN d || '/b_preview.mp4' END AS video_path, CASE WHEN h5 THEN 'hdf5://' || d || '/z.h5::camera_pose' END AS poses_path, CASE WHEN meta THEN 24.0::DOUBLE END AS fps, meta OR k % 2 = 0 AS has_moving_camera,
 array_to_string(list_filter([CASE WHEN h5 THEN 'hdf5_keys_not_scanned_fast_manifest' END, CASE WHEN h5 AND NOT video THEN 'needs_video_preview_or_decode' END], lambda x: x IS NOT NULL), ',') AS flags FROM m WHERE h5 OR video""")
def capture_scan(spark, sf_dir):
    """Samples of the second source from a listing, with JSON sidecars and without a scan of keys."""
    k = F.col("s_suppkey")
    d = F.concat(F.lit("/cap/"), k.cast("string"), F.when(k % 2 == 0, "_orbit").otherwise("_containment"))
    some = [F.when(k % 3 > 0, "z.h5"), F.when(k % 4 > 0, "b_preview.mp4"), F.when(k % 4 > 0, "a.mp4"), F.when(k % 5 == 0, "metadata.json"), F.lit("other.txt")]
    files = read(spark, sf_dir, "supplier").select(d.alias("folder"), F.explode(F.array_compact(F.array(*some))).alias("name"))
    meta = files.filter("name = 'metadata.json'").select(F.concat_ws("/", "folder", "name").alias("path"), F.lit('{"trial_type": "trial", "camera_path": "dolly", "fps": 24, "template": ""}').alias("text"))
    out = S.scan_captures(files, meta)
    return out.select("sample_id", "template", "camera_motion", "video_path", "poses_path", "fps", "has_moving_camera", F.array_join("quality_flags", ",").alias("flags"))


@query("""WITH f AS (SELECT o_custkey AS folder, ['a.safetensors', 'b.bin', 'config.json', 'model.index.json', 'notes'][o_orderkey % 5 + 1] AS name, o_orderkey AS length FROM orders)
SELECT folder, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes, CAST(count_if(name = 'a.safetensors') AS BIGINT) AS safetensors, CAST(count_if(name = 'b.bin') AS BIGINT) AS bins, bool_or(name = 'config.json') AS has_config, bool_or(name = 'model.index.json') AS has_index FROM f GROUP BY 1""")
def weight_census(spark, sf_dir):
    names = F.array(*map(F.lit, ["a.safetensors", "b.bin", "config.json", "model.index.json", "notes"]))
    return S.checkpoint_census(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("folder"), F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("name"), F.col("o_orderkey").alias("length")))


@query("""WITH m AS (SELECT o_custkey AS zip, o_orderkey % 40 AS stem, CASE WHEN o_orderkey % 3 = 0 THEN 'depth' ELSE 'rgb' END AS kind, 'CineCamera_' || (o_orderkey % 2) AS camera FROM orders)
SELECT zip, camera, count(*) AS n, CAST(min(stem) AS INTEGER) AS first, CAST(max(stem) AS INTEGER) AS last FROM m WHERE kind = 'rgb' GROUP BY ALL""")
def archive_pictures(spark, sf_dir):
    """The pictures of each camera of an archive (customer) in the order of their numbers."""
    k = F.col("o_orderkey")
    camera, kind = F.concat(F.lit("CineCamera_"), (k % 2).cast("string")), F.when(k % 3 == 0, "depth").otherwise("rgb")
    m = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("zip"), F.concat(F.lit("t/"), camera, F.lit("/"), kind, F.lit("/f"), (k % 40).cast("string"), F.lit(".jpg")).alias("member"), (k % 40).cast("int").alias("stem"))
    number = lambda i: F.regexp_extract(F.element_at("frames", i), r"f(\d+)\.jpg$", 1).cast("int")
    return S.frame_members(m).select("zip", "camera", F.size("frames").cast("long").alias("n"), number(1).alias("first"), number(-1).alias("last"))


@query("""SELECT p_partkey, nullif(p_size - 1, 0) AS num_frames, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 30000 / 1001.0::DOUBLE END AS fps, p_size * 8 AS width, CASE WHEN p_size % 2 = 0 THEN 480 END AS height FROM part""")
def probe_records(spark, sf_dir):
    """What a media probe prints, as numbers."""
    s = F.col("p_size")
    text = F.concat(F.lit('{"streams": [{"nb_frames": "'), (s - 1).cast("string"), F.lit('", "r_frame_rate": "'), F.when(s % 3 == 0, "0/0").otherwise("30000/1001"), F.lit('", "width": '), (s * 8).cast("string"),
                    F.when(s % 2 == 0, F.lit(', "height": 480')).otherwise(""), F.lit("}]}"))
    return S.probe_text(read(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "text").select("p_partkey", "num_frames", "fps", "width", "height")


@query("SELECT event_id AS step, props AS payload FROM events WHERE event_id % 4 > 0")
def metric_log(spark, sf_dir):
    """A stream of metric records appended to a log of JSON lines; empty ones go."""
    path, ckpt = storage.new_path(spark, "log"), storage.new_path(spark, "log-state")
    e = spark.readStream.schema(read(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    rows = e.select(F.lit(0.0).alias("time"), F.col("event_id").alias("step"), F.when(F.col("event_id") % 4 > 0, F.col("props")).when(F.col("event_id") % 8 == 0, "{}").alias("payload"))
    P.append_log(rows, path, ckpt).awaitTermination()
    return spark.read.schema(schemas.METRIC_LOG_DDL).json(path).select("step", "payload")


@query("""SELECT event_id, event_id % 10 > 0 AS ok, CASE WHEN event_id % 10 > 0 THEN round(value * 2, 6) END AS score, CASE WHEN event_id % 10 = 0 THEN 'ValueError: no frame' END AS error FROM events""")
def scored_alone(spark, sf_dir):
    """A scorer that fails on every tenth clip; the others are scored."""

    def score(row: dict) -> dict:
        if row["event_id"] % 10 == 0:
            raise ValueError("no frame")
        return {"score": round(row["value"] * 2, 6)}

    return P.each_alone(read(spark, sf_dir, "events").select("event_id", "value"), score, "score double").select("event_id", "ok", "score", "error")


@query("""WITH m AS (SELECT s_suppkey, s_acctbal FROM supplier)
SELECT CAST(s_suppkey AS VARCHAR) AS method, CAST(s_suppkey / 2.0::DOUBLE AS VARCHAR) AS psnr, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE CAST(s_suppkey / 4.0::DOUBLE AS VARCHAR) END AS fvd FROM m""")
def final_summary(spark, sf_dir):
    """The summary table over models (suppliers): metrics rounded, blank where there is no number."""
    k = F.col("s_suppkey")
    models = read(spark, sf_dir, "supplier").select(k.cast("string").alias("model"), *[F.lit(None).cast("double").alias(c) for c in ("pmf", "ssim", "lpips")], (k / 2.0).alias("psnr"),
                                                                       F.when(k % 4 == 0, float("inf")).otherwise(k / 4.0).alias("fvd"))
    t = K.summary_table(models)
    return t.select(F.col("Method").alias("method"), F.col(K.SUMMARY_COLUMNS["psnr"]).alias("psnr"), F.col(K.SUMMARY_COLUMNS["fvd"]).alias("fvd"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def known_outputs(spark, sf_dir):
    """Produced files that the manifest knows, with their row there."""
    done = read(spark, sf_dir, "labels").select("doc_id").distinct()
    return V.known(done, read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Camera_Poses' WHEN 1 THEN 'scene/camera_pose_world' WHEN 2 THEN 'poses' END AS poses, CASE s_suppkey % 4 WHEN 0 THEN 12 WHEN 1 THEN 7 WHEN 2 THEN 9 END AS n FROM supplier""")
def key_choice(spark, sf_dir):
    """The array of poses among the keys of a file: equal to a hint but for case, else containing one; and its length."""
    k = F.col("s_suppkey") % 4
    pairs = F.when(k == 0, F.create_map(F.lit("my_camera_pose"), F.lit(3), F.lit("Camera_Poses"), F.lit(12))).when(k == 1, F.create_map(F.lit("depth"), F.lit(5), F.lit("scene/camera_pose_world"), F.lit(7))).when(
        k == 2, F.create_map(F.lit("x_camera_matrix"), F.lit(8), F.lit("poses"), F.lit(9))).otherwise(F.create_map(F.lit("other"), F.lit(1)))
    f = read(spark, sf_dir, "supplier").select("s_suppkey", pairs.alias("m"))
    best = M.best_key(F.map_keys("m"), ["camera_pose", "camera_poses", "poses", "camera_matrix"])
    return f.select("s_suppkey", best.alias("poses"), F.try_element_at(F.col("m"), best).alias("n"))


@query("SELECT r_name AS name, r_regionkey AS n FROM region UNION ALL SELECT 'absent', 7")
def json_document(spark, sf_dir):
    """A JSON document written and read, and the default of one that isn't there."""
    path = storage.new_path(spark, "document")
    r = read(spark, sf_dir, "region").select("r_name", "r_regionkey")
    r.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("r_name", "r_regionkey")))).alias("value")).write.text(path)  # five rows
    whole = S.read_json_document(spark, path) | S.read_json_document(spark, f"{path}-none", {"absent": 7})
    return spark.createDataFrame(list(whole.items()), "name string, n int")
