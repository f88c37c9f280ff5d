"""Column builders for windows, sampling, vectors and geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ints(n: Column) -> Column:
    """0 to n - 1; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def window_starts(n: Column, size: int, stride: int) -> Column:
    """Starts of windows every ``stride`` frames and one that ends with the last frame; short clips have one, at 0."""
    step = stride if stride > 0 else size
    last = (n - F.lit(size)).cast("int")
    return F.when(n <= size, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step)), F.array(last))))


def window_frames(start: Column, n: Column, size: int) -> Column:
    """Frame numbers of a window; beyond the end the last frame repeats."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.least(start + i, (n - 1).cast("int")))


def uniform_frames(n: Column, size: int) -> Column:
    """``size`` frame numbers from first to last at even steps, rounded half to even."""
    if size == 1:
        return F.array(F.lit(0))
    last = (n - 1).cast("int")
    step = last.cast("double") / F.lit(float(size - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == size - 1, last).otherwise(F.rint(i.cast("double") * step).cast("int")))


def pad_or_cut(values: Column, size: int) -> Column:
    """Exactly ``size`` values: longer arrays are cut, shorter ones repeat their last value; empty ones stay empty."""
    last = F.try_element_at(values, F.lit(-1))
    return F.when(F.size(values) == 0, values).otherwise(F.slice(F.concat(values, F.array_repeat(last, size)), 1, size))


def gather(values: Column, at: Column) -> Column:
    """Values at the given places; null beyond the end."""
    return F.transform(at, lambda i: F.get(values, i))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def mean(values: Column) -> Column:
    """Mean of an array; null for an empty one."""
    return F.try_divide(total(values), F.size(values))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, least: float = 1e-12) -> Column:
    """The vector at length 1; one shorter than ``least`` is divided by that."""
    size = F.greatest(norm(a), F.lit(least))
    return F.transform(a, lambda x: x.cast("double") / size)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def cross(a: Column, b: Column) -> Column:
    """Cross product of two vectors of three."""
    at = lambda v, i: F.get(v, F.lit(i))
    return F.array(*[at(a, (i + 1) % 3) * at(b, (i + 2) % 3) - at(a, (i + 2) % 3) * at(b, (i + 1) % 3) for i in range(3)])


def direction(a: Column, least: float = 1e-8) -> Column:
    """The vector at length 1; one no longer than ``least`` has no direction and is an error."""
    size = norm(a)
    return F.transform(a, lambda x: x / F.when(size > least, size).otherwise(F.raise_error(F.lit("a vector without direction")).cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(unit(a), unit(b))


def mean_abs_difference(a: Column, b: Column) -> Column:
    return mean(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def relation_matrix(tokens: Column) -> Column:
    """Cosines of all pairs of an item's few tokens (an array of vectors)."""
    units = F.transform(tokens, lambda t: unit(t))
    return F.transform(units, lambda a: F.transform(units, lambda b: dot(a, b)))


def pooled(tokens: Column, n: Column, size: int) -> Column:
    """Adaptive average pooling: bin i averages tokens from floor(i n / size) to ceil((i + 1) n / size)."""
    def bin_(i: Column) -> Column:
        lo = F.floor(i * n / size).cast("int")
        hi = F.ceil((i + 1) * n / size).cast("int")
        part = F.slice(tokens, lo + 1, hi - lo)
        sums = F.aggregate(F.slice(part, 2, 1 << 20), F.transform(F.get(part, F.lit(0)), lambda x: x.cast("double")), lambda s, t: F.zip_with(s, t, lambda x, y: x + y))
        return F.transform(sums, lambda x: x / (hi - lo))

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), bin_)


def resampled(frames: Column, n: Column, size: int) -> Column:
    """Linear interpolation in time to ``size`` frames, sampled at frame centres."""
    def at(i: Column) -> Column:
        x = F.greatest((i + 0.5) * n / size - 0.5, F.lit(0.0))
        lo = F.floor(x).cast("int")
        hi = F.least(lo + 1, (n - 1).cast("int"))
        part = x - lo
        return F.zip_with(F.get(frames, lo), F.get(frames, hi), lambda a, b: a * (1 - part) + b * part)

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at)


def intrinsics(width: Column, height: Column, angle: Column) -> Column:
    """fx, fy, cx, cy of a camera with a horizontal field of view in radians."""
    f = 0.5 * width / F.tan(angle / 2)
    return F.struct(f.alias("fx"), f.alias("fy"), (width / 2).alias("cx"), (height / 2).alias("cy"))


def letterbox(width: Column, height: Column, to_w: int, to_h: int) -> Column:
    """Size and offset of a picture that is fitted whole into a box."""
    scale = F.least(F.lit(float(to_w)) / width, F.lit(float(to_h)) / height)
    w, h = F.greatest(F.rint(width * scale), F.lit(1.0)).cast("int"), F.greatest(F.rint(height * scale), F.lit(1.0)).cast("int")
    return F.struct(w.alias("width"), h.alias("height"), F.floor((F.lit(to_w) - w) / 2).cast("int").alias("left"), F.floor((F.lit(to_h) - h) / 2).cast("int").alias("top"))


def centre_crop(width: Column, height: Column, size: int) -> Column:
    """Size after the short side is made ``size``, and the offset of the centred square."""
    scale = F.lit(float(size)) / F.least(width, height)
    w, h = F.rint(width * scale).cast("int"), F.rint(height * scale).cast("int")
    return F.struct(w.alias("width"), h.alias("height"), F.floor((w - size) / 2).cast("int").alias("left"), F.floor((h - size) / 2).cast("int").alias("top"))


def token_grid(frames: Column, height: Column, width: Column, patch: int, tubelet: int) -> Column:
    """Token counts by time, height and width; sizes that don't divide are an error."""
    bad = (F.pmod(frames, F.lit(tubelet)) != 0) | (F.pmod(height, F.lit(patch)) != 0) | (F.pmod(width, F.lit(patch)) != 0)
    check = F.when(bad, F.raise_error(F.lit("size is no multiple of the patch")).cast("int")).otherwise(0)
    return F.struct((F.floor(frames / tubelet).cast("int") + check).alias("t"), F.floor(height / patch).cast("int").alias("h"), F.floor(width / patch).cast("int").alias("w"))


def drift(frame: Column, n: Column, width: Column, share: float = 0.04) -> Column:
    """Sideways shift in pixels of a drifting background, growing to ``share`` of the width."""
    return F.rint((frame + 1) * width / F.greatest(n, F.lit(1)) * share).cast("int")


def repeated(value: Column, n: Column | int) -> Column:
    """The same pose or intrinsics for each of ``n`` frames."""
    return F.array_repeat(value, n if isinstance(n, Column) else F.lit(n))


def signed_pixels(v: Column) -> Column:
    """Pixel values of 0 to 255 as -1 to 1."""
    return F.transform(v, lambda x: x.cast("double") / 127.5 - 1)


def unit_pixels(v: Column) -> Column:
    """Values of -1 to 1 as 0 to 1."""
    return F.transform(v, lambda x: (x.cast("double") + 1) / 2)


def sampled_without_first(n: Column, size: int, before: bool) -> Column:
    """Evenly sampled frame numbers without the first frame: it goes ``before`` sampling, else after it; a lone frame stays."""
    whole = uniform_frames(n, size)
    if before:
        return F.when(n > 1, F.transform(uniform_frames(n - 1, size), lambda i: i + 1)).otherwise(whole)
    return F.slice(whole, 2, size - 1) if size > 1 else whole


def zero_actions(n: Column, channels: int = 4) -> Column:
    return F.array_repeat(F.array(*[F.lit(0.0)] * channels), n)
