"""Readers for manifests, tables, file listings and media sidecars."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe import schemas
from lumenframe.functions import expr as E
from lumenframe.operators import manifest as M


def read_jsonl(spark: SparkSession, path: str, schema: str = schemas.SAMPLE_DDL) -> DataFrame:
    """JSON lines with a schema; blank lines go, bad lines are an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_raw(spark: SparkSession, path: str, schema: str = schemas.SAMPLE_DDL) -> DataFrame:
    """The same with the raw line in ``raw``, from which missing keys can be told from nulls."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.col("value").alias("raw"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("raw", "r.*")


def read_csv_rows(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header; all columns are text."""
    reader = spark.read.option("header", True)
    if columns:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    return reader.csv(path)


def read_cleanup(spark: SparkSession, path: str) -> DataFrame:
    """Cleanup candidates of a tab-separated file; rows without a path go."""
    return spark.read.option("header", True).option("sep", "\t").schema(schemas.CLEANUP_DDL).csv(path).filter(F.coalesce("path", F.lit("")) != "")


def read_json_document(spark: SparkSession, path: str, default: dict | None = None) -> dict:
    """One JSON document, read on the driver; ``default`` (if any) where it is missing."""
    try:
        text = spark.read.option("wholetext", True).text(path).first()
    except Exception as e:
        if default is not None and "PATH_NOT_FOUND" in str(e):
            return default
        raise
    return json.loads(text[0]) if text else dict(default or {})


def parse_json_or_empty(text: Column, schema: str) -> Column:
    """A struct from JSON text, all null where it can't be read."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def read_config(path: str) -> dict:
    """A YAML file, on the driver; a missing file is empty.  Without a YAML library top-level ``key: value`` lines count."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        pairs = (line.split(":", 1) for line in text.splitlines() if ":" in line and not line.startswith((" ", "#")))
        return {k.strip(): v.strip() for k, v in pairs}
    return yaml.safe_load(text) or {}


def read_env(path: str, base: dict[str, str] | None = None) -> dict[str, str]:
    """``KEY=VALUE`` lines in turn; ``$NAME`` and ``${NAME}`` take earlier keys, then the environment."""
    out: dict[str, str] = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            line = line.strip().removeprefix("export ")
            if line and not line.startswith("#") and "=" in line:
                key, value = line.split("=", 1)
                known = {**os.environ, **(base or {}), **out}
                value = value.strip().strip("'\"")
                for name in sorted(known, key=len, reverse=True):
                    value = value.replace(f"${{{name}}}", known[name]).replace(f"${name}", known[name])
                out[key.strip()] = value
    return out


def pick(*values: str | None) -> str | None:
    """The first value that is neither missing nor empty."""
    return next((v for v in values if v), None)


def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """path, name, folder, length of all files below ``root``; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    path = F.regexp_replace("path", "^file:/*", "/")
    return reader.load(root).select(path.alias("path"), "length").select("path", E.base_name(F.col("path")).alias("name"), F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "length")


def _folders(files: DataFrame, names: list[str], endings: str | None = None) -> DataFrame:
    """folder, files: those names of each folder that ``names`` has or whose ending fits; pictures and the like aren't gathered."""
    wanted = F.col("name").isin(names)
    return files.filter(wanted | F.lower("name").rlike(endings) if endings else wanted).groupBy("folder").agg(F.collect_set("name").alias("files"))


# Names of sidecar files in the order in which they are taken.
DEPTH_A, MASK_A, STATE_A = ["depth", "depth.npy"], ["id_mask", "id.npy", "mask.npy"], ["metadata.json", "object_state.json", "states.json"]
DEPTH_B, MASK_B = ["depth", "_depth", "depth.npy"], ["id_mask", "_id", "id.npy", "mask.npy"]
POSES_B, INTRINSICS_B, FRAMES_B = ["poses.npy", "camera_pose.npy", "camera_poses.npy"], ["intrinsics.npy", "camera_intrinsics.npy"], ["frames", "rgb", "_img"]
META_B = ["metadata.json", "tdw_commands.json", "summary.json"]


def scan_clips(files: DataFrame, moving: DataFrame | None = None) -> DataFrame:
    """Samples of the first source: a row for each folder of a listing that has ``video.mp4``.

    ``moving`` (poses_path, has_moving_camera) says which cameras move; without it none is known to.
    """
    d, f = F.col("folder"), F.col("files")
    out = _folders(files, ["video.mp4", *DEPTH_A, *MASK_A, *STATE_A, "poses.npy", "intrinsics.npy", "prompt.txt"]).filter(F.array_contains("files", "video.mp4"))
    first = lambda names: M.first_existing(f, d, names)
    out = out.select(
        E.stable_id(F.lit("phyinone"), d).alias("sample_id"), F.lit("phyinone").alias("source"), E.first_match(d, M.TEMPLATE_WORDS_A).alias("template"),
        E.first_match(d, M.CAMERA_WORDS).alias("camera_motion"), F.concat(d, F.lit("/video.mp4")).alias("video_path"), first(DEPTH_A).alias("depth_path"),
        first(MASK_A).alias("id_path"), first(["poses.npy"]).alias("poses_path"), first(["intrinsics.npy"]).alias("intrinsics_path"),
        F.coalesce(first(["prompt.txt"]), F.lit("generated://phyinone")).alias("prompt_path"), first(DEPTH_A).isNotNull().alias("has_depth"),
        first(MASK_A).isNotNull().alias("has_id_mask"), first(STATE_A).isNotNull().alias("has_object_state"))
    if moving is not None:
        out = out.join(moving.select("poses_path", "has_moving_camera"), "poses_path", "left").withColumn("has_moving_camera", F.coalesce("has_moving_camera", F.lit(False)))
    return M.conform(out)


def scan_captures(files: DataFrame, meta: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Samples of the second source: a row for each folder of a listing with an HDF5 or MP4 file.

    ``meta`` (path, text) holds the JSON sidecars, ``keys`` (path, keys, lengths) the arrays of the HDF5 files; without it
    the usual keys are taken as there and the rows are flagged.
    """
    d, f = F.col("folder"), F.col("files")
    ending = lambda *e: F.array_sort(F.filter(f, lambda n: F.lower(n).rlike(r"\.(" + "|".join(e) + ")$")))
    known = [*DEPTH_B, *MASK_B, *POSES_B, *INTRINSICS_B, *FRAMES_B, *META_B, "prompt.txt"]
    out = _folders(files, known, r"\.(h5|hdf5|mp4)$").withColumn("_h", F.get(ending("h5", "hdf5"), F.lit(0))).withColumn("_v", M.preferred_video(ending("mp4")))
    out = out.filter(F.col("_h").isNotNull() | F.col("_v").isNotNull())
    out = out.withColumn("_h", F.concat(d, F.lit("/"), "_h")).withColumn("_v", F.concat(d, F.lit("/"), "_v")).withColumn("_meta", M.first_existing(f, d, META_B))
    if meta is not None:
        out = out.join(meta.select(F.col("path").alias("_meta"), F.col("text").alias("_text")), "_meta", "left")
    else:
        out = out.withColumn("_text", F.lit(None).cast("string"))
    if keys is not None:
        out = out.join(keys.select(F.col("path").alias("_h"), F.col("keys").alias("_keys"), F.col("lengths").alias("_lengths")), "_h", "left")
        best = lambda *hints: M.best_key(F.coalesce("_keys", F.array().cast("array<string>")), list(hints))
        hp, hi, hd, hm = best("camera_pose", "camera_poses", "poses", "camera_matrix", "camera_matrices"), best("intrinsics", "camera_intrinsics", "K", "camera_K"), best("depth", "_depth", "depths"), best("id", "_id", "id_mask", "segmentation", "object_ids")
        state, n = best("object_state", "states", "objects"), F.try_element_at(F.col("_lengths"), hp)
    else:
        usual = lambda k: F.when(F.col("_h").isNotNull(), F.lit(k))
        hp, hi, hd, hm = usual("camera_pose"), usual("intrinsics"), usual("depth"), usual("id")
        state, n = F.lit(None).cast("string"), F.lit(None).cast("int")
    uri = lambda k: F.when(F.col("_h").isNotNull() & k.isNotNull(), F.concat(F.lit("hdf5://"), "_h", F.lit("::"), k))
    first = lambda names: M.first_existing(f, d, names)
    said = lambda k: F.get_json_object("_text", f"$.{k}")
    camera = E.or_else(said("camera_motion"), said("camera_path"), E.first_match(d, M.CAMERA_WORDS))
    poses, intr = first(POSES_B), first(INTRINSICS_B)
    return M.conform(out.select(
        E.stable_id(F.lit("movingcam_synthetic"), d).alias("sample_id"), F.lit("movingcam_synthetic").alias("source"),
        E.or_else(said("template"), said("trial_type"), E.first_match(d, M.TEMPLATE_WORDS_B)).alias("template"), camera.alias("camera_motion"), F.col("_v").alias("video_path"), F.col("_h").alias("hdf5_path"),
        first(FRAMES_B).alias("rgb_frames"), F.coalesce(first(DEPTH_B), uri(hd)).alias("depth_path"), F.coalesce(first(MASK_B), uri(hm)).alias("id_path"), F.coalesce(poses, uri(hp)).alias("poses_path"),
        F.coalesce(intr, uri(hi)).alias("intrinsics_path"), F.coalesce(first(["prompt.txt"]), F.lit("generated://movingcam_synthetic")).alias("prompt_path"), n.cast("int").alias("num_frames"),
        said("fps").try_cast("double").alias("fps"), said("width").try_cast("int").alias("width"), said("height").try_cast("int").alias("height"), (~camera.isin(*M.STILL_CAMERAS)).alias("has_moving_camera"),
        (hd.isNotNull() | first(DEPTH_B).isNotNull()).alias("has_depth"), (hm.isNotNull() | first(MASK_B).isNotNull()).alias("has_id_mask"), (F.col("_meta").isNotNull() | state.isNotNull()).alias("has_object_state"),
        M.quality_flags(F.col("_h"), keys is not None, F.coalesce(poses, hp), F.coalesce(intr, hi), F.col("_v")).alias("quality_flags")))


def scan_roots(root: str) -> list[str]:
    """The root and its neighbour ``outputs``, those that exist, each once."""
    found = [p for p in (root, os.path.join(os.path.dirname(root.rstrip("/")), "outputs")) if os.path.isdir(p)]
    return list(dict.fromkeys(os.path.realpath(p) for p in found))


def frame_members(members: DataFrame, kind: str = "rgb") -> DataFrame:
    """zip, camera, frames: the pictures of each camera in the order of their numbers."""
    pictures = members.filter(F.col("member").rlike(rf"/[^/]+/{kind}/[^/]+\.jpg$")).withColumn("camera", F.regexp_extract("member", rf"/([^/]+)/{kind}/[^/]+\.jpg$", 1))
    sorted_ = F.array_sort(F.collect_list(F.struct("stem", "member")))
    return pictures.groupBy("zip", "camera").agg(F.transform(sorted_, lambda s: s["member"]).alias("frames")).withColumn("camera_number", E.camera_number(F.col("camera")))


def ply_points(df: DataFrame, key: str, text: str, group: int = 9) -> DataFrame:
    """key, camera (index of the group of ``group`` points), point, x, y, z, r, g, b of ASCII PLY texts; bad ones are an error."""
    head = F.regexp_extract(text, r"(?s)^(ply\b.*?end_header)\r?\n", 1)
    n = F.regexp_extract(head, r"element vertex (\d+)", 1).try_cast("int")
    body = F.filter(F.split(F.regexp_replace(text, r"(?s)^ply\b.*?end_header\r?\n", ""), r"\r?\n"), lambda line: F.trim(line) != "")
    checked = df.withColumn("_n", F.when((head == "") | ~head.contains("format ascii"), F.raise_error(F.lit("no ASCII PLY file")).cast("int")).when(
        n.isNull(), F.raise_error(F.lit("no vertex count")).cast("int")).when(F.pmod(n, F.lit(group)) != 0, F.raise_error(F.lit("vertices don't make whole groups")).cast("int")).when(
        F.size(body) < n, F.raise_error(F.lit("fewer vertices than announced")).cast("int")).otherwise(n))
    points = checked.select(key, F.posexplode(F.slice(body, 1, F.col("_n"))).alias("pos", "line")).withColumn("v", F.split(F.trim("line"), r"\s+"))
    value = lambda i: F.when(F.size("v") < 6, F.raise_error(F.lit("a vertex has fewer than six values")).cast("double")).otherwise(F.get("v", F.lit(i)).cast("double"))
    return points.select(key, F.floor(F.col("pos") / group).cast("int").alias("camera"), F.pmod("pos", F.lit(group)).alias("point"), *[value(i).alias(c) for i, c in enumerate("xyzrgb")])


def camera_frames(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, frame, m: the poses of camera JSON texts in frame order; a matrix that isn't 4 x 4 is an error."""
    parsed = F.from_json(text, "frames array<struct<frame:int,transform_matrix:array<array<double>>>>")
    rows = df.select(key, F.explode(parsed["frames"]).alias("f")).select(key, "f.frame", F.col("f.transform_matrix").alias("m"))
    whole = (F.size("m") == 4) & F.forall("m", lambda r: F.size(r) == 4)
    return rows.withColumn("m", E.checked(F.col("m"), whole, "a pose isn't 4 x 4"))


def hdf5_keys(files: DataFrame, path: str = "path") -> DataFrame:
    """path, keys, lengths (key to first dimension) of HDF5 files; empty where the library or the file fails."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import h5py
        except ImportError:
            h5py = None
        for b in batches:
            rows = []
            for p in b[path]:
                found: dict[str, int | None] = {}
                if h5py is not None:
                    try:
                        with h5py.File(p, "r") as f:
                            f.visititems(lambda name, o, found=found: found.update({name: o.shape[0] if o.shape else None}) if hasattr(o, "shape") else None)
                    except OSError:
                        found = {}
                rows.append((p, list(found), found))
            yield pd.DataFrame(rows, columns=["path", "keys", "lengths"])

    return files.select(path).mapInPandas(look, "path string, keys array<string>, lengths map<string,int>")


def decode_frames(files: DataFrame, max_frames: int = 16, stride: int = 1, size: tuple[int, int] | None = None, required: bool = False) -> DataFrame:
    """path, frame, width, height, gray_mean, blur, brightness, saturation, pixels of each decoded frame.

    Needs OpenCV on the executors; a file that can't be read has no row, or is an error if ``required``.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import cv2

        for b in batches:
            for p in b.path:
                cap, rows, i = cv2.VideoCapture(p), [], 0
                while len(rows) < max_frames:
                    ok, img = cap.read()
                    if not ok:
                        break
                    if i % stride == 0:
                        img = cv2.resize(img, size) if size else img
                        gray, hsv = cv2.cvtColor(img, cv2.COLOR_BGR2GRAY), cv2.cvtColor(img, cv2.COLOR_BGR2HSV)
                        rows.append((p, len(rows), img.shape[1], img.shape[0], float(gray.mean()), float(cv2.Laplacian(gray, cv2.CV_64F).var()), float(hsv[..., 2].mean() / 255), float(hsv[..., 1].mean() / 255), img.ravel()))
                    i += 1
                cap.release()
                if required and not rows:
                    raise ValueError(f"no frame in {p}")
                yield pd.DataFrame(rows, columns=["path", "frame", "width", "height", "gray_mean", "blur", "brightness", "saturation", "pixels"])

    return files.select("path").mapInPandas(decode, "path string, frame int, width int, height int, gray_mean double, blur double, brightness double, saturation double, pixels array<int>")


def probe_text(df: DataFrame, text: str) -> DataFrame:
    """num_frames, fps, width, height from the JSON that a media probe prints; zeros are null."""
    stream = lambda k: F.get_json_object(text, f"$.streams[0].{k}")
    positive = lambda c: F.when(c > 0, c)
    return df.withColumns({"num_frames": positive(stream("nb_frames").try_cast("int")), "fps": positive(E.ratio(stream("r_frame_rate"))), "width": positive(stream("width").try_cast("int")), "height": positive(stream("height").try_cast("int"))})


def checkpoint_census(files: DataFrame) -> DataFrame:
    """folder, files, bytes, safetensors, bins, has_config, has_index of a listing."""
    return files.groupBy("folder").agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"), F.count_if(F.col("name").endswith(".safetensors")).alias("safetensors"),
        F.count_if(F.col("name").endswith(".bin")).alias("bins"), F.bool_or(F.col("name") == "config.json").alias("has_config"), F.bool_or(F.col("name").endswith(".index.json")).alias("has_index"))
