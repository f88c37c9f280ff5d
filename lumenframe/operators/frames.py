"""Statistics of frames held as bytes: sharpness, brightness, saturation and structural similarity, reduced to numbers in one pass.

A frame is a row with ``width``, ``height`` and ``pixels`` (8-bit red, green, blue, row by row).  Pixels are read once in Arrow batches and never leave the
task; what a task holds is one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Frames that Spark hands over at a time are cut into runs of about so many bytes of pixels.
SLICE_BYTES = 16 << 20
# Fixed values of the 8-bit colour conversions: weights of gray in 2^-14, and the scale of the saturation table.
GRAY, GRAY_SHIFT, SATURATION_SHIFT = (4899, 9617, 1868), 14, 12
# Fixed values of the structural similarity: side of the window, and the two constants as shares of the range.
WINDOW, K1, K2, RANGE = 7, 0.01, 0.03, 255.0
_TABLE = np.concatenate([[0], np.rint((255 << SATURATION_SHIFT) / np.arange(1, 256)).astype(np.int64)])


def picture(data: memoryview | bytes | None, width: int | None, height: int | None) -> np.ndarray | None:
    """Height x width x 3; None where the bytes don't fit the size."""
    if data is None or not width or not height or width < 0 or height < 0 or len(data) != 3 * width * height:
        return None
    return np.frombuffer(data, np.uint8).reshape(height, width, 3)


def gray(image: np.ndarray) -> np.ndarray:
    """8-bit gray."""
    return (image.astype(np.int64) @ np.array(GRAY) + (1 << GRAY_SHIFT - 1)) >> GRAY_SHIFT


def laplacian(values: np.ndarray) -> np.ndarray:
    """Sum of the four neighbours less four times the value; beyond an edge its inner neighbour is taken."""
    padded = np.pad(values, [(int(n > 1),) * 2 for n in values.shape], "reflect")
    rows = padded[2:] + padded[:-2] if values.shape[0] > 1 else 2 * padded
    columns = padded[:, 2:] + padded[:, :-2] if values.shape[1] > 1 else 2 * padded
    rows = rows[:, 1:-1] if values.shape[1] > 1 else rows
    columns = columns[1:-1] if values.shape[0] > 1 else columns
    return rows + columns - 4 * values


def statistics(image: np.ndarray) -> tuple[float, float, float, float]:
    """Mean gray, variance of the Laplacian of gray, mean brightness and mean saturation (the last two as shares)."""
    plain = gray(image)
    most, least = image.max(axis=2).astype(np.int64), image.min(axis=2).astype(np.int64)
    saturation = ((most - least) * _TABLE[most] + (1 << SATURATION_SHIFT - 1)) >> SATURATION_SHIFT
    return float(plain.mean()), float(laplacian(plain.astype(np.float64)).var()), float(most.mean() / 255), float(saturation.mean() / 255)


def window_sums(values: np.ndarray, side: int) -> np.ndarray:
    """Sums of all square windows, from running sums along each axis."""
    for axis in (0, 1):
        run = np.cumsum(values, axis=axis)
        run = np.concatenate([np.zeros_like(run.take([0], axis)), run], axis)
        n = run.shape[axis]
        values = run.take(range(side, n), axis) - run.take(range(n - side), axis)
    return values


def structural_similarity(a: np.ndarray, b: np.ndarray) -> float | None:
    """Mean structural similarity of two frames over all whole windows and channels; None where the sizes differ or are below a window."""
    if a.shape != b.shape or min(a.shape[:2]) < WINDOW:
        return None
    x, y, n = a.astype(np.float64), b.astype(np.float64), WINDOW * WINDOW
    mx, my, xx, yy, xy = (window_sums(v, WINDOW) / n for v in (x, y, x * x, y * y, x * y))
    sample = n / (n - 1)
    vx, vy, vxy = sample * (xx - mx * mx), sample * (yy - my * my), sample * (xy - mx * my)
    c1, c2 = (K1 * RANGE) ** 2, (K2 * RANGE) ** 2
    return float((((2 * mx * my + c1) * (2 * vxy + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))).mean())


def cut(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[pa.RecordBatch]:
    """Batches of at most SLICE_BYTES of the given columns, or one row."""
    for b in batches:
        ends = np.cumsum(sum(np.array([len(x) if x is not None else 0 for x in map(memory, b.column(c))], np.int64) for c in columns))
        start = 0
        while start < b.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE_BYTES, side="right")))
            yield b.slice(start, stop - start)
            start = stop


def memory(value: pa.BinaryScalar) -> memoryview | None:
    return memoryview(value.as_buffer()) if value.is_valid else None


def frame_statistics(frames: DataFrame, key: str = "clip", frame: str = "frame") -> DataFrame:
    """key, frame, gray_mean, blur, brightness, saturation of each frame (key, frame, width, height, pixels).

    A frame whose bytes don't fit its size, or without them, has nulls.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, "pixels"):
            out = []
            for data, w, h in zip(map(memory, b.column("pixels")), b.column("width").to_pylist(), b.column("height").to_pylist(), strict=True):
                image = picture(data, w, h)
                out.append((None,) * 4 if image is None else statistics(image))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([o[i] for o in out], pa.float64()) for i in range(4)]], ["key", "frame", "gray_mean", "blur", "brightness", "saturation"])

    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    rows = frames.select(F.col(key).alias("key"), F.col(frame).alias("frame"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "pixels")
    out = rows.mapInArrow(measure, f"key {kinds[key]}, frame {kinds[frame]}, gray_mean double, blur double, brightness double, saturation double")
    return out.withColumnRenamed("key", key).withColumnRenamed("frame", frame)


def clip_quality(statistics_: DataFrame, key: str = "clip", frame: str = "frame") -> DataFrame:
    """key, blur_var_mean, brightness_mean, saturation_mean, brightness_flicker, num_frames of each clip; flicker is 0 for one frame."""
    step = F.abs(F.col("brightness") - F.lag("brightness").over(Window.partitionBy(key).orderBy(frame)))
    return statistics_.filter("brightness IS NOT NULL").withColumn("_step", step).groupBy(key).agg(
        F.avg("blur").alias("blur_var_mean"), F.avg("brightness").alias("brightness_mean"), F.avg("saturation").alias("saturation_mean"),
        F.coalesce(F.avg("_step"), F.lit(0.0)).alias("brightness_flicker"), F.count("*").alias("num_frames"))


def frame_similarity(reference: DataFrame, candidate: DataFrame, key: str = "clip", frame: str = "frame") -> DataFrame:
    """key, frame, ssim of the frames that both sides (key, frame, width, height, pixels) have; null where sizes differ or are below a window."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, "a", "b"):
            column = {c: b.column(c).to_pylist() for c in ("wa", "ha", "wb", "hb")}
            out = []
            for i, (x, y) in enumerate(zip(map(memory, b.column("a")), map(memory, b.column("b")), strict=True)):
                one, two = picture(x, column["wa"][i], column["ha"][i]), picture(y, column["wb"][i], column["hb"][i])
                out.append(None if one is None or two is None else structural_similarity(one, two))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], ["key", "frame", "ssim"])

    kinds = {f.name: f.dataType.simpleString() for f in reference.schema}
    side = lambda d, s: d.select(F.col(key).alias("key"), F.col(frame).alias("frame"), F.col("width").cast("int").alias(f"w{s}"), F.col("height").cast("int").alias(f"h{s}"), F.col("pixels").alias(s))
    both = side(reference, "a").join(side(candidate, "b"), ["key", "frame"])
    out = both.mapInArrow(compare, f"key {kinds[key]}, frame {kinds[frame]}, ssim double")
    return out.withColumnRenamed("key", key).withColumnRenamed("frame", frame)


def clip_similarity(frames: DataFrame, key: str = "clip") -> DataFrame:
    """key, ssim: the mean over the frames that have one."""
    return frames.groupBy(key).agg(F.avg("ssim").alias("ssim"), F.count("ssim").alias("frames"))


class ClipFrames:
    """Table function (clip bytes, width, height, most frames, stride): frame, width, height, pixels of every stride-th frame, at most so many (all if 0).

    A clip is its frames one after the other.  Bytes that aren't whole frames, or sizes that aren't, give no row, as a file that can't be read does.
    """

    @staticmethod
    def analyze(clip: AnalyzeArgument, width: AnalyzeArgument, height: AnalyzeArgument, most: AnalyzeArgument, stride: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(clip.dataType, S.BinaryType):
            raise ValueError(f"a clip is binary, not {clip.dataType.simpleString()}")
        for a in (width, height, most, stride):
            if not isinstance(a.dataType, S.IntegralType):
                raise ValueError("sizes and numbers of frames are whole numbers")
        whole = S.IntegerType()
        return AnalyzeResult(S.StructType([S.StructField("frame", whole), S.StructField("width", whole), S.StructField("height", whole), S.StructField("pixels", S.BinaryType())]))

    def eval(self, clip: bytes | None, width: int | None, height: int | None, most: int | None, stride: int | None) -> Iterator[tuple]:
        size = 3 * (width or 0) * (height or 0)
        if clip is None or size <= 0 or width <= 0 or len(clip) % size:
            return
        taken = range(0, len(clip) // size, max(1, stride or 1))
        for n, i in enumerate(taken[: most or None]):
            yield n, width, height, bytes(clip[i * size : (i + 1) * size])


def clip_frames(clips: DataFrame, clip: str = "pixels", width: str = "width", height: str = "height", most: int = 0, stride: int = 1) -> DataFrame:
    """The other columns of ``clips`` with frame, width, height, pixels of each clip's frames, numbered from 0; a clip that can't be read has no row.

    A lateral join: a task makes the frames of its clips one after the other.
    """
    made = F.udtf(ClipFrames)(F.col("_clip").outer(), F.col("_width").outer(), F.col("_height").outer(), F.lit(most), F.lit(stride))
    named = clips.select(*[F.col(c) for c in clips.columns if c not in (clip, width, height)], F.col(clip).alias("_clip"), F.col(width).cast("int").alias("_width"), F.col(height).cast("int").alias("_height"))
    return named.lateralJoin(made).drop("_clip", "_width", "_height")
