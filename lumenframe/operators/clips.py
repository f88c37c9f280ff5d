"""Clips: windows over ordered frames, motion statistics, actions and frame comparisons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lumenframe.functions import arrays as A
from lumenframe.functions import expr as E

#: Fixed value: what names of cameras begin with.
CAMERA_PREFIX = "CineCamera_"


def clip_windows(lengths: DataFrame, size: int, stride: int, mode: str = "contiguous", key: str = "clip", length: str = "n") -> DataFrame:
    """key, window, start, frames for each window of each clip; one evenly sampled window in mode ``uniform``."""
    n = F.col(length)
    if mode == "uniform":
        return lengths.select(key, F.lit(0).alias("window"), F.lit(0).alias("start"), A.uniform_frames(n, size).alias("frames"))
    if mode != "contiguous":
        raise ValueError(f"unknown sampling mode: {mode}")
    starts = lengths.select(key, length, F.posexplode(A.window_starts(n, size, stride)).alias("window", "start"))
    return starts.select(key, "window", "start", A.window_frames(F.col("start"), n, size).alias("frames"))


def clip_members(windows: DataFrame, frames: DataFrame, key: str = "clip", frame: str = "frame") -> DataFrame:
    """The rows of ``frames`` that each window takes, in place order; a frame that isn't there is an error."""
    want = windows.select(key, "window", F.posexplode("frames").alias("place", frame))
    out = want.join(frames.withColumn("_there", F.lit(True)), [key, frame], "left")
    return out.withColumn(frame, E.checked(F.col(frame), F.col("_there"), F.concat(F.lit("no frame "), F.col(frame).cast("string")))).drop("_there")


def path_length(frames: DataFrame, key: str, frame: str, axes: list[str]) -> DataFrame:
    """num_frames, translation_total, translation_mean and has_moving_camera of each clip's positions."""
    order = Window.partitionBy(key).orderBy(frame)
    step = F.sqrt(sum(((F.col(a) - F.lag(a).over(order)) ** 2 for a in axes), F.lit(0.0)))
    return frames.withColumn("_step", step).groupBy(key).agg(
        F.count("*").alias("num_frames"), F.coalesce(F.sum("_step"), F.lit(0.0)).alias("translation_total"),
        F.coalesce(F.avg("_step"), F.lit(0.0)).alias("translation_mean")).withColumn("has_moving_camera", F.col("translation_total") > 1e-4)


def difference_stats(frames: DataFrame, key: str, frame: str, pixels: str, scale: float = 255.0) -> DataFrame:
    """num_pairs, mean_absdiff, max_absdiff between each frame's pixel array and the next's."""
    order = Window.partitionBy(key).orderBy(frame)
    diffs = frames.select(key, (A.mean_abs_difference(F.col(pixels), F.lag(pixels).over(order)) / scale).alias("d"))
    return diffs.groupBy(key).agg(F.count("d").alias("num_pairs"), F.avg("d").alias("mean_absdiff"), F.max("d").alias("max_absdiff"))


def flicker(frames: DataFrame, key: str, frame: str, brightness: str) -> DataFrame:
    """Mean brightness of each clip and the mean change from frame to frame."""
    order = Window.partitionBy(key).orderBy(frame)
    d = frames.withColumn("_d", F.abs(F.col(brightness) - F.lag(brightness).over(order)))
    return d.groupBy(key).agg(F.avg(brightness).alias("brightness_mean"), F.coalesce(F.avg("_d"), F.lit(0.0)).alias("brightness_flicker"))


def first_last(frames: DataFrame, key: str, frame: str, pixels: str, scale: float = 255.0, least: int = 4) -> DataFrame:
    """Likeness of the first and the last frame of clips with at least ``least`` frames."""
    ends = frames.groupBy(key).agg(F.count("*").alias("num_frames"), F.min_by(pixels, frame).alias("a"), F.max_by(pixels, frame).alias("b"))
    return ends.filter(F.col("num_frames") >= least).select(key, (1 - A.mean_abs_difference(F.col("a"), F.col("b")) / scale).alias("similarity"))


def psnr(a: DataFrame, b: DataFrame, key: str, frame: str, pixels: str, peak: float = 255.0) -> DataFrame:
    """Peak signal-to-noise ratio of two clips over the frames that both have; infinite for equal ones."""
    both = a.select(key, frame, F.col(pixels).alias("_a")).join(b.select(key, frame, F.col(pixels).alias("_b")), [key, frame])
    square = F.zip_with("_a", "_b", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    sums = both.select(key, A.total(square).alias("s"), F.size(square).alias("n")).groupBy(key).agg((F.sum("s") / F.sum("n")).alias("mse"))
    return sums.select(key, "mse", F.when(F.col("mse") == 0, float("inf")).otherwise(10 * F.log10(F.lit(peak * peak) / F.col("mse"))).alias("psnr"))


def aligned(a: DataFrame, b: DataFrame, key: str, a_order: str, b_order: str) -> DataFrame:
    """The k-th row of a beside the k-th of b for each key; counts that differ are an error."""
    x = a.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(a_order)))
    y = b.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(b_order)))
    both = x.withColumn("_x", F.lit(1)).join(y.withColumn("_y", F.lit(1)), [key, "_k"], "full")
    return both.withColumn(key, E.checked(F.col(key), F.col("_x").isNotNull() & F.col("_y").isNotNull(), "counts differ")).drop("_k", "_x", "_y")


def rotation_vector(r: list[list[Column]]) -> list[Column]:
    """Axis times angle of a rotation matrix, with the limits at no turn and at half a turn."""
    trace = r[0][0] + r[1][1] + r[2][2]
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))
    angle = F.acos(cos)
    anti = [r[2][1] - r[1][2], r[0][2] - r[2][0], r[1][0] - r[0][1]]
    size = F.sqrt(sum((x * x for x in anti), F.lit(0.0)))
    # At half a turn the antisymmetric part vanishes; the axis is the largest column of R + 1.
    plus = [[r[i][j] + (1.0 if i == j else 0.0) for j in range(3)] for i in range(3)]
    diagonal = [plus[i][i] for i in range(3)]
    big = F.greatest(*diagonal)
    out = []
    for i in range(3):
        axis = F.when(diagonal[0] == big, plus[i][0]).when(diagonal[1] == big, plus[i][1]).otherwise(plus[i][2])
        length = F.sqrt(F.when(diagonal[0] == big, sum((plus[k][0] ** 2 for k in range(3)), F.lit(0.0))).when(
            diagonal[1] == big, sum((plus[k][1] ** 2 for k in range(3)), F.lit(0.0))).otherwise(sum((plus[k][2] ** 2 for k in range(3)), F.lit(0.0))))
        out.append(F.when(size > 1e-9, angle * anti[i] / size).when(cos > 0, anti[i] / 2).otherwise(angle * axis / length))
    return out


def pose_actions(poses: DataFrame, key: str = "clip", frame: str = "frame", matrix: str = "m") -> DataFrame:
    """key, frame, forward, strafe, yaw, pitch from each 4 x 4 camera pose to the next; the last repeats the one before."""
    order = Window.partitionBy(key).orderBy(frame)
    m = lambda c, i, j: F.get(F.get(c, F.lit(i)), F.lit(j)).cast("double")
    both = poses.withColumn("_next", F.lead(matrix).over(order))
    now = [[m(F.col(matrix), i, j) for j in range(4)] for i in range(3)]
    then = [[m(F.col("_next"), i, j) for j in range(4)] for i in range(3)]
    move = [sum((now[k][i] * (then[k][3] - now[k][3]) for k in range(3)), F.lit(0.0)) for i in range(3)]
    turn = [[sum((now[k][i] * then[k][j] for k in range(3)), F.lit(0.0)) for j in range(3)] for i in range(3)]
    v = rotation_vector(turn)
    steps = both.select(key, frame, move[2].alias("forward"), move[0].alias("strafe"), v[1].alias("yaw"), v[0].alias("pitch"))
    for c in ("forward", "strafe", "yaw", "pitch"):
        steps = steps.withColumn(c, F.coalesce(F.col(c), F.lag(c).over(order), F.lit(0.0)))
    return steps


def camera_groups(points: DataFrame, key: str) -> DataFrame:
    """key, group, color, points of the drawn cameras (rows of ``ply_points``), without the red one, which is the moving camera.

    A drawn camera has nine points and the colour of its first; so a group is small whatever the table.
    """
    xyz = F.array(*[F.col(c).cast("double") for c in "xyz"])
    ordered = F.array_sort(F.collect_list(F.struct("point", xyz.alias("at"))))
    groups = points.groupBy(key, F.col("camera").alias("group")).agg(
        F.min_by(F.array(*[F.col(c).cast("int") for c in "rgb"]), "point").alias("color"), F.transform(ordered, lambda p: p["at"]).alias("points"))
    return groups.filter(F.col("color") != F.array(F.lit(255), F.lit(0), F.lit(0)))


def frustum_poses(groups: DataFrame, points: str = "points") -> DataFrame:
    """``groups`` with ``m``, the 4 x 4 camera-to-world matrix of each drawn camera (an array of nine points).

    Point 0 is the camera's place; 6 lies on its x axis, 7 on the side of y, and 8 against z.  A vector without
    length is an error.
    """
    place = F.transform(F.get(points, F.lit(0)), lambda v: v.cast("double"))
    away = lambda i: A.minus(F.get(points, F.lit(i)), F.col("_c"))
    out = groups.withColumn("_c", place).withColumn("_x", A.direction(away(6)))
    along = A.dot(away(7), F.col("_x"))
    out = out.withColumn("_y", A.direction(F.zip_with(away(7), "_x", lambda h, x: h - along * x)))
    out = out.withColumn("_z", A.direction(A.cross(F.col("_x"), F.col("_y"))))
    turned = A.dot(F.col("_z"), A.direction(F.transform(away(8), lambda v: -v))) < 0
    out = out.withColumn("_z", F.when(turned, F.transform("_z", lambda v: -v)).otherwise(F.col("_z")))
    out = out.withColumn("_y", A.direction(A.cross(F.col("_z"), F.col("_x"))))
    rows = [F.array(*[F.get(c, F.lit(i)) for c in ("_x", "_y", "_z", "_c")]) for i in range(3)]
    return out.withColumn("m", F.array(*rows, F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)]))).drop("_c", "_x", "_y", "_z")


def camera_order(name: Column) -> Column:
    """Sort key of cameras: the number after the prefix, then the name; names without one come last."""
    number = F.regexp_extract(name, CAMERA_PREFIX + r"(\d+)", 1).try_cast("int")
    return F.struct(F.coalesce(number, F.lit(10**9)).alias("number"), name.alias("name"))


def camera_poses(points: DataFrame, cameras: DataFrame, key: str, camera: str = "camera") -> DataFrame:
    """key, camera, m: the k-th camera by number beside the k-th drawn camera that isn't red; counts that differ are an error."""
    names = cameras.select(key, camera).withColumn("_at", camera_order(F.col(camera)))
    drawn = frustum_poses(camera_groups(points, key)).select(key, F.col("group").alias("_group"), "m")
    return aligned(names, drawn, key, "_at", "_group").select(key, camera, "m")


#: Cells of each pass of the search for a rank; size of the sketch that brackets it, points of its grid, and points to each side of a rank.
CELLS, SKETCH, GRID, ASIDE = 4096, 1024, 500, 3


def values_at(df: DataFrame, ranks: dict[str, Callable[[int], list[int]]]) -> dict[str, list[float]]:
    """Exact values at 0-based ranks of several columns; ``ranks`` maps a column to the ranks for its count.

    A quantile sketch brackets each rank.  A pass counts the rows below the bracket, above it, and in CELLS cells between its ends, and goes on in the part
    that holds the rank, until that holds a single value: one pass as a rule, and a bracket that misses the rank costs another one.  Counts are merged before the shuffle and at most CELLS rows for each rank
    come to the driver, so nothing grows with the table.  Null, NaN and infinite values don't count.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in ranks])).alias("p")).select("p.*").filter(E.finite(F.col("v")))
    grid = F.kll_sketch_get_quantile_double("s", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])).alias("grid")
    ends = long.groupBy("c").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.kll_sketch_agg_double("v", SKETCH).alias("s"))
    goals = []
    for r in ends.select("c", "n", "low", "high", grid).collect():  # a row a column
        for k in ranks[r.c](r.n):
            at = k * GRID // max(r.n - 1, 1)
            goals.append([r.c, k, max(r.low, r.grid[max(0, at - ASIDE)]), min(r.high, r.grid[min(GRID, at + 1 + ASIDE)])])
    found = {c: [] for c in ranks}
    order, first = list(goals), True
    while goals := [g for g in goals if first or g[2] != g[3]]:
        v = F.col("v")
        within = lambda low, high: F.least(F.floor((v - low) / F.lit((high - low) or 1.0) * CELLS), F.lit(CELLS - 1))
        cell = lambda low, high: F.when(v.between(low, high), within(low, high)).when(F.lit(first) & (v < low), F.lit(-1)).when(F.lit(first), F.lit(CELLS))  # noqa: E731, B023
        held = F.explode(F.array(*[F.struct(F.lit(i).alias("goal"), F.when(F.col("c") == c, cell(low, high)).alias("cell")) for i, (c, _, low, high) in enumerate(goals)])).alias("g")
        cells = long.select("c", "v", held).filter("g.cell IS NOT NULL").groupBy("g.goal", "g.cell").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        for i, g in enumerate(goals):
            for r in sorted((r for r in cells if r.goal == i), key=lambda r: r.cell):
                if g[1] < r.n:
                    g[2], g[3] = r.low, r.high
                    break
                g[1] -= r.n
        first = False
    for c, _, value, _ in order:
        found[c].append(value)
    return found


def action_scale(actions: DataFrame, channels: list[str], share: float = 0.95, least: float = 1e-6) -> DataFrame:
    """One row: the exact percentile (interpolated) of each channel's size, not below ``least``; only finite values count."""
    sizes = actions.select(*[F.abs(F.col(c)).alias(c) for c in channels])
    parts: dict[str, float] = {}

    def around(c: str) -> Callable[[int], list[int]]:
        def ranks(n: int) -> list[int]:
            at = share * (n - 1)
            parts[c] = at - int(at)
            return [int(at), min(int(at) + 1, n - 1)]

        return ranks

    found = values_at(sizes, {c: around(c) for c in channels})
    row = [max(least, v[0] + (v[1] - v[0]) * parts[c]) if (v := found[c]) else least for c in channels]
    return actions.sparkSession.createDataFrame([tuple(row)], ", ".join(f"`{c}` double" for c in channels))


def normalise_actions(actions: DataFrame, scale: DataFrame, channels: list[str]) -> DataFrame:
    """Channels divided by their scale (one row), between -1 and 1."""
    one = scale.select(*[F.col(c).alias(f"_s_{c}") for c in channels])
    out = actions.crossJoin(F.broadcast(one))  # a row of numbers
    return out.withColumns({c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(c) / F.col(f"_s_{c}"))) for c in channels}).drop(*[f"_s_{c}" for c in channels])


def repeat_moving(df: DataFrame, moving: Column, times: int) -> DataFrame:
    """All rows, and ``times`` - 1 further copies of the moving ones; ``copy`` numbers them from 0."""
    n = F.when(F.coalesce(moving, F.lit(False)), F.lit(max(times, 1))).otherwise(1)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), n - 1)))


def archive_clips(frames: DataFrame, size: int, stride: int, mode: str = "contiguous") -> DataFrame:
    """A row for each window of each camera of each archive: zip, camera, window_index, window_start_frame, window_end_frame, raw_frame_count, members.

    ``frames`` (zip, camera, frames) holds the ordered picture names of each camera; a camera without pictures has no window.
    """
    cameras = frames.filter(F.size("frames") > 0).select("zip", "camera", "frames", F.size("frames").alias("n"))
    at = F.array(F.lit(0)) if mode == "uniform" else A.window_starts(F.col("n"), size, stride)
    taken = A.uniform_frames(F.col("n"), size) if mode == "uniform" else A.window_frames(F.col("start"), F.col("n"), size)
    out = cameras.select("*", F.posexplode(at).alias("window_index", "start")).withColumn("taken", taken)
    return out.select("zip", "camera", "window_index", F.get("taken", F.lit(0)).alias("window_start_frame"), F.element_at("taken", -1).alias("window_end_frame"),
                      F.col("n").alias("raw_frame_count"), A.gather(F.col("frames"), F.col("taken")).alias("members"))


def clip_counts(clips: DataFrame, moving: str) -> DataFrame:
    """One row for each split: archives, clips, unique_clips, moving rows (of the camera ``moving``) and static rows (without action).

    ``clips`` has split, source_zip, clip_path, camera_id and action_source.
    """
    return clips.groupBy("split").agg(
        F.countDistinct("source_zip").alias("archives"), F.count("*").alias("clips"), F.countDistinct("clip_path").alias("unique_clips"),
        F.count_if(F.col("camera_id") == moving).alias("moving"), F.count_if(F.col("action_source") == "static_camera_zero").alias("static"))


def chosen_cameras(available: DataFrame, spec: str, key: str = "zip", camera: str = "camera") -> DataFrame:
    """The cameras that ``spec`` names, all of them for an empty one, ``all`` or ``*``.

    Else it is a list between commas of names, or of numbers that get the prefix; cameras that an archive hasn't are passed over.
    """
    wanted = (spec or "all").strip()
    if wanted.lower() in ("all", "*"):
        return available.select(key, camera).distinct()
    names = [t if t.startswith(CAMERA_PREFIX) else CAMERA_PREFIX + t for t in (t.strip() for t in wanted.split(",")) if t]
    return available.filter(F.col(camera).isin(names)).select(key, camera).distinct()


def absent_cameras(available: DataFrame, spec: str, key: str = "zip", camera: str = "camera") -> DataFrame:
    """The cameras of ``spec`` that an archive hasn't (for a warning)."""
    names = [t if t.startswith(CAMERA_PREFIX) else CAMERA_PREFIX + t for t in (t.strip() for t in (spec or "").split(",")) if t and t.lower() not in ("all", "*")]
    asked = available.select(key).distinct().select(key, F.explode(F.array(*[F.lit(n) for n in names]).cast("array<string>")).alias(camera))
    return asked.join(available.select(key, camera), [key, camera], "left_anti")


def epochs(df: DataFrame, repeat: int) -> DataFrame:
    """The table ``repeat`` times, with the number of the pass in ``epoch``."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max(repeat, 1) - 1))))


def corrupt_frames(frames: DataFrame, kind: str, key: str, frame: str, width: str | None = None) -> DataFrame:
    """Frame tables of corrupted clips: ``source_frame`` is what each place shows, ``dx`` how far it is shifted."""
    whole = Window.partitionBy(key)
    last, n = F.max(frame).over(whole), F.count("*").over(whole)
    first = F.min(frame).over(whole)
    source, dx = F.col(frame), F.lit(0)
    if kind in ("freeze_camera", "global_freeze"):
        source = first
    elif kind in ("camera_shuffle", "wrong_camera_motion"):
        source = first + last - F.col(frame)
    elif kind == "background_drift":
        dx = A.drift(F.row_number().over(whole.orderBy(frame)) - 1, n, F.col(width))
    return frames.withColumn("source_frame", source).withColumn("dx", dx)
