"""Operators on hand-made rows: edge rows of the fixtures, empty tables, ties."""

import json

import pytest
from pyspark.sql import functions as F

from lumenframe import schemas
from lumenframe.operators import clips as C
from lumenframe.operators import evaluation as V
from lumenframe.operators import manifest as M
from lumenframe.operators import preferences as P
from lumenframe.operators import rewards as R
from lumenframe.operators import training as T
from lumenframe.sources import readers, writers
from lumenframe.streaming import progress as S


def sample(spark, **values):
    base = {"sample_id": "s1", "source": "phyinone", "template": "drop", "camera_motion": "static"} | values
    return M.conform(spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in base.items())))


STATS = ("sample_id string, source string, template string, camera_motion string, num_pairs int, mean_absdiff double, max_absdiff double, mean_absdiff16 double, max_absdiff16 double, "
         "translation_total double, has_id_mask boolean, id_path string, blur double, brightness double, saturation double, flicker double, first_last double")


def stats(spark, **v):
    base = dict(sample_id="s1", source="phyinone", template="drop", camera_motion="static", num_pairs=11, mean_absdiff=0.01, max_absdiff=0.02, mean_absdiff16=0.01, max_absdiff16=0.02,
                translation_total=0.0, has_id_mask=False, id_path=None, blur=60.0, brightness=0.5, saturation=0.06, flicker=0.06, first_last=None) | v
    return spark.createDataFrame([tuple(base.values())], STATS)


def test_minimal_sample_is_valid(spark):
    s = sample(spark)
    raw = json.dumps({k: None for k in schemas.SAMPLE_FIELDS})
    checked = M.validation_errors(s.withColumn("raw", F.lit(raw)), "raw").first()
    assert checked.errors == [] and checked.quality_flags == [] and checked.has_depth is False


def test_missing_key_is_not_null(spark):
    raw = json.dumps({k: None for k in schemas.SAMPLE_FIELDS if k != "fps"})
    assert M.validation_errors(sample(spark, source="x").withColumn("raw", F.lit(raw)), "raw").first().errors == ["missing:fps", "invalid:source"]


def test_missing_paths(spark):
    s = sample(spark, video_path="/v.mp4", poses_path="hdf5:///a::k", prompt_path="generated://x", hdf5_path="").withColumn("raw", F.lit(json.dumps({k: 1 for k in schemas.SAMPLE_FIELDS})))
    files = spark.createDataFrame([("/other",)], "path string")
    assert M.validation_errors(s, "raw", files).first().errors == ["missing_path:video_path"]


def test_pair_errors(spark):
    ok = {"pair_id": "p1", "condition": {}, "winner": {"video": "a"}, "loser": {"video": None}, "pair_type": "x", "margin": 1.0, "quality_flags": []}
    bad = {k: v for k, v in ok.items() if k != "margin"} | {"winner": {}}
    got = spark.createDataFrame([(json.dumps(ok),), (json.dumps(bad),)], "raw string").select(M.pair_errors(F.col("raw")).alias("e")).collect()
    assert [r.e for r in got] == [[], ["missing:margin", "missing:winner.video"]]


def test_semantic_labels_are_case_sensitive(spark):
    lab = lambda **v: M.with_splits(sample(spark, **v)).collect()
    assert {r.split for r in lab(camera_motion="Lookaway")} & {"reobserve"} == set()
    assert {"reobserve", "static_camera_physics", "stress"} <= {r.split for r in lab(camera_motion="yaw", quality_flags=["f"])}
    assert M.camera_audit(sample(spark, camera_motion="LookAway")).first().reobserve_candidates == 1


def test_prompts(spark):
    s = sample(spark, camera_motion="reobserve")
    assert s.select(M.prompt("p0", F.col("template"), F.col("camera_motion")).alias("p")).first().p == M.PROMPT_SHORT
    text = s.select(M.prompt("P2", F.col("template"), F.col("camera_motion")).alias("p")).first().p
    assert "gravity-driven drop event" in text and "leaves and returns" in text
    with pytest.raises(ValueError):
        M.prompt("P9", F.lit(""), F.lit(""))


def test_shuffle_split_counts(spark):
    df = spark.range(200).select(F.concat(F.lit("z"), "id").alias("path"))
    got = {r.split: r.n for r in M.shuffle_split(df, "path", 0.15, 3).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got == {"val": 30, "train": 170}


def test_best_key_and_video(spark):
    row = spark.createDataFrame([(["a/Camera_Pose_x", "POSES", "z"], ["b.mp4", "a_preview.mp4"])], "k array<string>, v array<string>")
    got = row.select(M.best_key(F.col("k"), ["camera_pose", "poses"]).alias("k"), M.preferred_video(F.col("v")).alias("v")).first()
    assert tuple(got) == ("POSES", "a_preview.mp4")


@pytest.mark.parametrize("values, part, want", [
    ({"num_pairs": None}, "bg", 0.0), ({"translation_total": None}, "cam", 0.0), ({}, "cam", 1 - 0.01 / 0.08), ({"translation_total": 5e-5}, "cam", 0.0),
    ({"has_id_mask": True}, "fg", 0.5), ({"id_path": "x"}, "fg", 0.5), ({}, "fg", 0.99), ({"template": "unknown"}, "phys", 0.5), ({"template": None, "num_pairs": None}, "phys", 0.0),
    ({"camera_motion": "Yaw"}, "reobs", 1.0), ({"camera_motion": "yaw"}, "reobs", 0.0), ({"camera_motion": "yaw", "first_last": 0.7}, "reobs", 0.7), ({"brightness": 0.0}, "quality", (0.5 + 1 + 0.5 + 0.5) / 4),
])
def test_components(spark, values, part, want):
    assert R.score(stats(spark, **values)).select(f"components.{part}.score").first()[0] == pytest.approx(want)


@pytest.mark.parametrize("values, penalty, reasons", [
    ({"num_pairs": 0}, 0.0, ["missing_generated_bg_flow"]), ({"mean_absdiff": 0.004, "translation_total": 1.0}, 0.5, ["camera_expected_but_background_nearly_static"]),
    ({"mean_absdiff": 0.001}, 0.25, ["dynamic_template_but_video_nearly_static"]), ({"mean_absdiff": 0.001, "template": "support"}, 0.0, []),
])
def test_freeze(spark, values, penalty, reasons):
    got = R.score(stats(spark, **values)).select("components.freeze.*").first()
    assert (got.penalty, got.reasons) == (penalty, reasons)


def test_overrides(spark):
    row = stats(spark)
    nan = F.lit(float("nan"))
    got = row.select(R.physics(nan).score.alias("p"), R.background(F.lit(2.0)).score.alias("b"), R.foreground(F.lit(0.5), F.lit(0.5)).score.alias("f"), R.quality(F.lit(0.2), F.lit(0.4)).score.alias("q"),
                     R.freeze(foreground_flow=F.lit(0.0), expected_foreground=F.lit(1.0)).penalty.alias("z")).first()
    assert got.p == 1.0 and got.b == pytest.approx(0.36787944) and got.f == 0.25 and got.q == pytest.approx(0.3) and got.z == 0.5


def test_weights_all_zero(spark):
    got = R.score(stats(spark), dict.fromkeys(R.WEIGHTS, 0.0)).first()
    assert got.reward_raw == 0.0 and got.weights["quality"] == 0.0


def pairs(spark, total):
    s = sample(spark, video_path="/v")
    reward = R.score(stats(spark)).withColumn("reward_total", F.lit(total))
    return P.pairs(reward, s)


def test_pair_margin_at_the_edge(spark):
    assert pairs(spark, 0.05).count() == 4 and pairs(spark, 0.0499).count() == 0
    row = pairs(spark, 0.9).first()
    assert row.margin == 0.9 - (0.9 - 0.35) and row.loser.reward.reward_raw == row.winner.reward.reward_raw


def test_unknown_corruption_is_left_out(spark):
    assert P.pairs(R.score(stats(spark)).withColumn("reward_total", F.lit(1.0)), sample(spark), ["freeze_camera", "nonsense"]).count() == 1
    assert P.corruption_records(sample(spark, video_path="/v"), "/out").filter("loser_video LIKE '/out/%'").count() == 11


def test_failed_renderings_are_flagged(spark):
    failed = spark.createDataFrame([("s1", "global_freeze"), ("s1", "remove_object")], "sample_id string, corruption string")
    got = {r.corruption: r for r in P.corruption_records(sample(spark, video_path="/v"), "/out", failed).collect()}
    assert got["global_freeze"].quality_flags == ["corruption_failed:global_freeze"] and got["global_freeze"].loser_video.startswith("corruption://")
    assert got["remove_object"].quality_flags == []


def test_anchored_edges(spark):
    p = pairs(spark, 1.0)
    assert P.anchored(p.withColumn("margin", F.lit(0.05))).count() == 4
    frozen = lambda x: p.withColumn("winner", F.col("winner").withField("reward", F.col("winner.reward").withField("components", F.col("winner.reward.components").withField("freeze", F.struct(F.lit(x).alias("penalty"), F.array().cast("array<string>").alias("reasons"))))))
    assert P.anchored(frozen(0.6)).count() == 4 and P.anchored(frozen(0.61)).count() == 0


def test_empty_aggregates(spark):
    none = spark.createDataFrame([], "sample_id string, corruption string, reward_total double")
    assert P.mean_reward(none).first().mean_reward is None
    assert P.calibration(none).filter("n > 0").count() == 0
    assert V.metric_summary(spark.createDataFrame([], "psnr string"), ["psnr"]).count() == 0


def test_best_checkpoint_takes_the_earliest_of_ties(spark):
    rows = [("b", 2, 1.0, None, 1.0, 1.0, 0.1), ("a", 1, 1.0, float("inf"), 1.0, 1.0, 0.1), ("c", 3, 0.5, 0.0, 9.0, 9.0, 0.0)]
    df = spark.createDataFrame(rows, "tag string, step int, pmf double, fvd double, psnr double, ssim double, lpips double")
    assert V.best_checkpoint(df).first().tag == "a"


def test_last_duplicate_on_the_right_wins(spark):
    m = spark.createDataFrame([("c", 1), ("c", 2), ("", 3), (None, 4)], "clip_name string, m int")
    p = spark.createDataFrame([("c", 1, 10), ("c", 2, 20), ("", 3, 30)], "clip_name string, pos int, p int")
    assert sorted((r.m, r.p) for r in V.joined_scores(m, p).collect()) == [(1, 20), (2, 20)]


def test_completeness(spark):
    e = spark.createDataFrame([("a",), ("b",)], "k string")
    V.require_complete(e, e, "k")
    with pytest.raises(RuntimeError, match="missing: b"):
        V.require_complete(e, e.filter("k = 'a'"), "k")


def test_numeric_audit_raises(spark):
    df = spark.createDataFrame([("a", [1.0, float("nan")])], "k string, v array<double>")
    assert V.numeric_audit(df, "k", "v").first().all_finite is False
    with pytest.raises(Exception, match="finite"):
        V.require_finite(V.numeric_audit(df, "k", "v")).collect()


def test_actions_of_a_quarter_turn(spark):
    eye = [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0], [0, 0, 0, 1.0]]
    turned = [[0.0, 0, 1.0, 1], [0, 1.0, 0, 0], [-1.0, 0, 0, 2], [0, 0, 0, 1.0]]
    half = [[-1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, -1.0, 0], [0, 0, 0, 1.0]]
    f = lambda m: [[float(x) for x in r] for r in m]
    df = spark.createDataFrame([("a", 0, f(eye)), ("a", 1, f(turned)), ("b", 0, f(eye)), ("c", 0, f(eye)), ("c", 1, f(half))], "clip string, frame int, m array<array<double>>")
    got = {(r.clip, r.frame): r for r in C.pose_actions(df).collect()}
    a = got["a", 0]
    assert (a.forward, a.strafe) == (2.0, 1.0) and a.yaw == pytest.approx(1.5707963) and a.pitch == pytest.approx(0.0)
    assert got["a", 1].forward == 2.0 and got["b", 0].yaw == 0.0 and abs(got["c", 0].yaw) == pytest.approx(3.1415927)


FRUSTUM = [(0, 0, 0), (1, 1, 2), (-1, 1, 2), (-1, -1, 2), (1, -1, 2), (0, 0, 0)]


def drawn(spark, six, seven, eight, place=(0, 0, 0)):
    points = [list(map(float, p)) for p in (place, *FRUSTUM[1:], six, seven, eight)]
    return C.frustum_poses(spark.createDataFrame([(points,)], "points array<array<double>>"))


def test_frustum_axes_come_from_the_last_three_points(spark):
    m = drawn(spark, (1, 0, 0), (0, 1, 0), (0, 0, 1)).first().m
    assert [[round(v, 9) + 0.0 for v in r] for r in m] == [[1, 0, 0, 0], [0, -1, 0, 0], [0, 0, -1, 0], [0, 0, 0, 1]]
    m = drawn(spark, (3, 2, 5), (1.5, 4, 5), (1, 2, 1), (1, 2, 5)).first().m
    assert [[round(v, 9) + 0.0 for v in r] for r in m] == [[1, 0, 0, 1], [0, 1, 0, 2], [0, 0, 1, 5], [0, 0, 0, 1]]


def test_frustum_without_length_is_an_error(spark):
    with pytest.raises(Exception, match="without direction"):
        drawn(spark, (0, 0, 1e-9), (0, 1, 0), (0, 0, 1)).collect()


def test_red_cameras_do_not_count(spark):
    rows = [("z", g, p, float(x), float(y), float(z), 255, 0 if g == 1 else 9, 0) for g in range(3) for p, (x, y, z) in enumerate([(g, 0, 0), *FRUSTUM[1:], (g + 1, 0, 0), (g, 1, 0), (g, 0, -1)])]
    points = spark.createDataFrame(rows, "zip string, camera int, point int, x double, y double, z double, r int, g int, b int")
    names = lambda *n: spark.createDataFrame([("z", x) for x in n], "zip string, camera string")
    got = {r.camera: r.m[0][3] for r in C.camera_poses(points, names("CineCamera_10", "CineCamera_9"), "zip").collect()}
    assert got == {"CineCamera_9": 0.0, "CineCamera_10": 2.0}
    with pytest.raises(Exception, match="counts differ"):
        C.camera_poses(points, names("CineCamera_1", "CineCamera_2", "CineCamera_3"), "zip").collect()


def test_exact_percentiles(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    for values in (rng.normal(size=5000), [1.0] * 900 + [2.0] * 100, [5.0], [1e-300, 1e300, 3.0, 3.0], rng.integers(0, 4, 777).astype(float)):
        df = spark.createDataFrame([(float(v), None) for v in values] + [(None, None), (float("nan"), None)], "a double, b double")
        got = C.action_scale(df, ["a", "b"]).first()
        assert got.a == pytest.approx(max(1e-6, float(np.percentile(np.abs(values), 95))), rel=1e-12) and got.b == 1e-6
    assert C.action_scale(df.limit(0), ["a"]).first().a == 1e-6


def test_percentiles_look_at_few_cells(spark, monkeypatch):
    monkeypatch.setattr(C, "CELLS", 3)
    df = spark.range(1000).select((F.col("id") * F.col("id")).cast("double").alias("a"))
    assert C.values_at(df, {"a": lambda n: [0, 1, n // 2, n - 1]}) == {"a": [0.0, 1.0, 500.0**2, 999.0**2]}


def test_pairs_without_fields_are_not_anchored(spark):
    raw = spark.createDataFrame([('{"pair_id":1,"condition":{},"winner":{"video":"a"},"loser":{"video":"b"},"pair_type":"t","margin":1,"quality_flags":[]}',),
                                 ('{"pair_id":1,"winner":{"video":"a"},"loser":{"video":"b"},"pair_type":"t","margin":1,"quality_flags":[]}',)], "raw string")
    reward = F.struct(F.lit(0.5).alias("reward_total"), F.struct(F.struct(F.lit(0.0).alias("penalty")).alias("freeze")).alias("components"))
    p = raw.select("raw", F.lit(1.0).alias("margin"), F.struct(F.lit("a").alias("video"), reward.alias("reward")).alias("winner"), F.struct(F.lit("b").alias("video")).alias("loser"))
    assert P.anchored(p, raw="raw").count() == 1
    with pytest.raises(ValueError, match="condition"):
        P.anchored(p)


def test_absent_keys_and_nulls_count_apart(spark):
    s = spark.createDataFrame([('{"source":null}', None), ('{"source":"a"}', "a"), ("{}", None)], "raw string, source string")
    assert {(r.value, r.n) for r in M.marginals(s, ["source"], "missing", "raw").collect()} == {(None, 1), ("a", 1), ("missing", 1)}
    assert {(r.field, r.value, r.n) for r in M.marginals(s, ["source", "other"], "unknown").collect()} == {("source", None, 2), ("source", "a", 1), ("other", "unknown", 3)}


def test_final_summary_files(spark, tmp_path):
    import csv
    import json

    m = spark.createDataFrame([("base", 1.0, 2.0, None, 0.12345, float("inf"))], "model string, pmf double, psnr double, ssim double, lpips double, fvd double")
    writers.write_final_summary(m, str(tmp_path / "q"), manifest_path="m.jsonl")
    rows = list(csv.reader(open(tmp_path / "q" / "metrics_summary.csv", encoding="utf-8")))
    assert rows[1] == ["base", "1.0", "2.0", "", "0.1235", ""] and (tmp_path / "q" / "metrics_summary.md").read_text(encoding="utf-8").count("\n") == 3
    assert json.load(open(tmp_path / "q" / "metrics_summary.json"))["manifest_path"] == "m.jsonl"
    writers.write_final_summary(m, str(tmp_path / "dry"), dry_run=True)
    assert not (tmp_path / "dry").exists()


def test_shared_folder_must_be_named_on_a_cluster(monkeypatch):
    from lumenframe import storage

    class Conf(dict):
        get = lambda self, k, d=None: dict.get(self, k, d)

    context = type("C", (), {"master": "spark://host:7077", "getConf": lambda self: Conf()})()
    session = type("S", (), {"conf": Conf(), "sparkContext": context})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(session)
    session.conf[storage.SETTING] = "hdfs:///x/"
    assert storage.shared_dir(session) == "hdfs:///x"


def test_psnr_of_equal_clips_is_infinite(spark):
    f = spark.createDataFrame([("a", 0, [1, 2]), ("a", 1, [3, 4])], "clip string, frame int, px array<int>")
    assert C.psnr(f, f.filter("frame = 0"), "clip", "frame", "px").first().psnr == float("inf")


def test_window_members_must_exist(spark):
    w = C.clip_windows(spark.createDataFrame([("a", 3)], "clip string, n int"), 2, 2)
    frames = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y")], "clip string, frame int, v string")
    with pytest.raises(Exception, match="no frame"):
        C.clip_members(w, frames).collect()


def test_positional_join_needs_equal_counts(spark):
    a = spark.createDataFrame([("k", 2, "a2"), ("k", 1, "a1")], "k string, o int, a string")
    b = spark.createDataFrame([("k", 5, "b1"), ("k", 7, "b2")], "k string, p int, b string")
    assert sorted((r.a, r.b) for r in C.aligned(a, b, "k", "o", "p").collect()) == [("a1", "b1"), ("a2", "b2")]
    with pytest.raises(Exception, match="counts differ"):
        C.aligned(a, b.limit(1), "k", "o", "p").collect()


def test_relation_loss(spark):
    same = [[[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0], [1.0, 0.0]]]
    other = [[[1.0, 0.0], [1.0, 0.0]], [[1.0, 0.0], [1.0, 0.0]]]
    df = spark.createDataFrame([(same, other)], "s array<array<array<double>>>, t array<array<array<double>>>")
    got = df.select(T.relation_loss(F.col("s"), F.col("t")).alias("l"), T.relation_loss(F.col("s"), F.col("s")).alias("z")).first()
    assert got.l.spatial == pytest.approx((2 * 0.9) / 8) and got.z.total == 0.0 and got.l.temporal > 0


def test_jsonl_round_trip(spark, tmp_path):
    s = sample(spark, video_path="/v")
    assert writers.write_jsonl(s, str(tmp_path / "m")) == 1
    back = readers.read_jsonl_raw(spark, str(tmp_path / "m"))
    assert back.first().video_path == "/v" and M.validation_errors(back, "raw").first().errors == []
    assert writers.write_jsonl(s, str(tmp_path / "dry"), dry_run=True) == 1 and not (tmp_path / "dry").exists()
    assert writers.write_splits(M.with_splits(s), str(tmp_path / "sp"))["static_camera_physics"] == 1


def test_bad_json_line_is_an_error(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"sample_id": "a"}\n\n{oops\n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "x.jsonl")).collect()


def test_scans(spark, tmp_path):
    for name in ("fall_yaw180/video.mp4", "fall_yaw180/poses.npy", "fall_yaw180/mask.npy", "x/cap.h5", "x/b.mp4", "x/a_aligned.MP4", "x/metadata.json", "y/readme.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("{}")
    files = readers.list_files(spark, str(tmp_path))
    a = readers.scan_clips(files).collect()
    assert len(a) == 1 and (a[0].template, a[0].camera_motion, a[0].has_id_mask, a[0].prompt_path) == ("drop", "relative_yaw_180_reobserve", True, "generated://phyinone")
    meta = spark.createDataFrame([(f"{tmp_path}/x/metadata.json", '{"trial_type": "roll", "camera_path": "orbit", "fps": 24}')], "path string, text string")
    b = {r.video_path.split("/")[-1]: r for r in readers.scan_captures(files, meta).collect()}
    row = b["a_aligned.MP4"]
    assert (row.template, row.camera_motion, row.fps, row.has_moving_camera) == ("roll", "orbit", 24.0, True)
    assert row.poses_path == f"hdf5://{tmp_path}/x/cap.h5::camera_pose" and row.quality_flags == ["hdf5_keys_not_scanned_fast_manifest"]
    both = M.build_manifest([readers.scan_clips(files), readers.scan_captures(files)], limit=1)
    assert [r.source for r in both.collect()] == ["movingcam_synthetic", "phyinone"]


def test_ply(spark):
    head = "ply\nformat ascii 1.0\nelement vertex %d\nend_header\n"
    body = "".join(f"{i} 0 0 255 0 0\n" for i in range(18))
    df = lambda t: spark.createDataFrame([("p", t)], "key string, text string")
    got = readers.ply_points(df(head % 18 + body), "key", "text")
    assert got.count() == 18 and got.filter("camera = 1 AND point = 0").first().x == 9.0
    for bad in (head % 17 + body, head % 27 + body, "x", head.replace("element vertex %d\n", "") + body):
        with pytest.raises(Exception):
            readers.ply_points(df(bad), "key", "text").collect()


def test_metric_log_drops_empty_payloads(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"time":1.0,"step":1,"payload":"{\\"x\\":1}"}\n{"time":2.0,"step":2,"payload":"{}"}\n')
    stream = spark.readStream.schema(schemas.METRIC_LOG_DDL).json(str(tmp_path / "in"))
    S.append_log(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [r.step for r in spark.read.schema(schemas.METRIC_LOG_DDL).json(str(tmp_path / "out")).collect()] == [1]


def test_driver_side_helpers(tmp_path, monkeypatch):
    (tmp_path / "e.env").write_text("# c\nexport ROOT=/r\nA=$ROOT/a\nB=\"${A}/b\"\n")
    assert readers.read_env(str(tmp_path / "e.env")) == {"ROOT": "/r", "A": "/r/a", "B": "/r/a/b"}
    assert readers.pick("", None, "x") == "x" and readers.read_config(str(tmp_path / "none.yaml")) == {}
    writers.write_json_document({"b": 1, "a": 2}, str(tmp_path / "d" / "x.json"))
    assert json.loads((tmp_path / "d" / "x.json").read_text()) == {"a": 2, "b": 1}
