"""Frame statistics, structural similarity and relation losses against plain numpy versions."""

import numpy as np
import pytest

from lumenframe.operators import frames as P
from lumenframe.operators import relations as R


def image(seed, h, w):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3), dtype=np.uint8)


def plain_laplacian(g):
    h, w = g.shape
    at = lambda i, n: 0 if n == 1 else -i if i < 0 else 2 * (n - 1) - i if i >= n else i
    return np.array([[g[at(y - 1, h), x] + g[at(y + 1, h), x] + g[y, at(x - 1, w)] + g[y, at(x + 1, w)] - 4 * g[y, x] for x in range(w)] for y in range(h)])


@pytest.mark.parametrize("size", [(9, 5), (1, 6), (6, 1), (1, 1), (2, 2)])
def test_laplacian(size):
    g = np.random.default_rng(1).integers(0, 256, size).astype(float)
    assert np.array_equal(P.laplacian(g), plain_laplacian(g))


def test_known_colours():
    plain = lambda *c: P.statistics(np.full((4, 4, 3), c, np.uint8))
    assert plain(255, 255, 255) == (255.0, 0.0, 1.0, 0.0) and plain(255, 0, 0) == (76.0, 0.0, 1.0, 1.0) and plain(0, 0, 0) == (0.0, 0.0, 0.0, 0.0)
    assert plain(0, 128, 64)[2:] == (128 / 255, 1.0) and plain(200, 100, 150)[3] == 127 / 255


def test_structural_similarity():
    a, b = image(1, 12, 10), image(2, 12, 10)
    values = []
    for ch in range(3):
        for y in range(6):
            for x in range(4):
                p, q = (v[y : y + 7, x : x + 7, ch].astype(float) for v in (a, b))
                c = ((p - p.mean()) * (q - q.mean())).sum() / 48
                values.append((2 * p.mean() * q.mean() + 6.5025) * (2 * c + 58.5225) / ((p.mean() ** 2 + q.mean() ** 2 + 6.5025) * (p.var(ddof=1) + q.var(ddof=1) + 58.5225)))
    assert P.structural_similarity(a, b) == pytest.approx(np.mean(values), abs=1e-9) and P.structural_similarity(a, a) == pytest.approx(1)
    assert P.structural_similarity(a[:6], b[:6]) is None and P.structural_similarity(a, b[:11]) is None


def test_frames_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(P, "SLICE_BYTES", 500)
    rows = [("a", i, 10, 12, image(i, 12, 10).tobytes()) for i in range(5)] + [("b", 0, 10, 12, None), ("b", 1, 10, 12, b"xx"), ("b", 2, None, 12, b""), ("c", 0, 1, 1, b"\x00\x00\x00"), (None, None, -1, -1, b"\x00\x00\x00")]
    df = spark.createDataFrame(rows, "clip string, frame int, width int, height int, pixels binary")
    got = {(r.clip, r.frame): r for r in P.frame_statistics(df).collect()}
    for i in range(5):
        assert tuple(got["a", i])[2:] == pytest.approx(P.statistics(image(i, 12, 10)))
    assert all(got[k].blur is None for k in (("b", 0), ("b", 1), ("b", 2), (None, None))) and len(got) == len(rows)
    quality = {r.clip: r for r in P.clip_quality(P.frame_statistics(df)).collect()}
    bright = [P.statistics(image(i, 12, 10))[2] for i in range(5)]
    assert quality["a"].brightness_flicker == pytest.approx(np.abs(np.diff(bright)).mean()) and quality["c"].brightness_flicker == 0 and quality.keys() == {"a", "c"}
    same = {(r.clip, r.frame): r.ssim for r in P.frame_similarity(df, df).collect()}
    assert same["a", 3] == pytest.approx(1) and same["b", 0] is None and same["c", 0] is None
    assert P.frame_statistics(df.limit(0)).collect() == []


def tokens(spark, arrays):
    rows = [(item, f, k, v.tolist()) for item, a in arrays.items() for f, frame in enumerate(a) for k, v in enumerate(frame)]
    return spark.createDataFrame(rows, "item string, frame int, token int, vector array<double>")


def plain_distillation(s, t, size, margin):
    """Frames x tokens x channels of both; the formulas written out."""
    n = len(s)
    place = np.maximum((np.arange(n) + 0.5) * len(t) / n - 0.5, 0)
    low = np.minimum(np.floor(place).astype(int), len(t) - 1)
    w = (place - low)[:, None, None]
    t = t[low] * (1 - w) + t[np.minimum(low + 1, len(t) - 1)] * w
    pool = lambda x: np.stack([x[:, i * x.shape[1] // size : -(-(i + 1) * x.shape[1] // size)].mean(axis=1) for i in range(size)], 1)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    s, t = unit(pool(s)), unit(pool(t))
    over = lambda a, b: np.maximum(np.abs(a - b) - margin, 0)
    spatial = over(np.einsum("fnd,fmd->fnm", s, s), np.einsum("fnd,fmd->fnm", t, t)).mean()
    a, b = s.mean(axis=1), t.mean(axis=1)
    return spatial, (over(a @ a.T, b @ b.T) * (1 - np.eye(n))).sum() / max(n * (n - 1), 1)


def test_relation_distillation(spark):
    rng = np.random.default_rng(1)
    s = {"x": rng.normal(size=(5, 7, 4)), "y": rng.normal(size=(1, 3, 4)), "z": rng.normal(size=(4, 6, 4))}
    t = {"x": rng.normal(size=(3, 5, 4)), "y": rng.normal(size=(4, 9, 4)), "z": rng.normal(size=(4, 2, 4)), "only": rng.normal(size=(2, 2, 4))}
    got = {r["item"]: r for r in R.relation_distillation(tokens(spark, s), tokens(spark, t), 3, 0.05, 1.0, 2.0).collect()}
    assert got.keys() == s.keys()
    for k in s:
        want = plain_distillation(s[k], t[k], 3, 0.05)
        assert (got[k].spatial, got[k].temporal) == pytest.approx(want) and got[k].total == pytest.approx(want[0] + 2 * want[1])


def test_blocks_of_a_large_frame(spark):
    """4096 tokens: 136 pairs of tiles, no row for a pair of tokens, and the sums of the whole matrices."""
    rng = np.random.default_rng(2)
    s, t = rng.normal(size=(1, 4096, 8)), rng.normal(size=(1, 4096, 8))
    one, two = tokens(spark, {"x": s}), tokens(spark, {"x": t})
    got = R.block_sums(one, two, 0.1).first()
    apart = s[0] @ s[0].T - t[0] @ t[0].T
    over = np.maximum(np.abs(apart) - 0.1, 0)
    assert (got.squares, got.beyond, got.diagonal, got.pairs) == pytest.approx(((apart**2).sum(), over.sum(), np.trace(over), 4096**2))
    assert R.tile_pairs(R.tiles_of(one, ["vector"], R.TILE), ["vector"]).count() == 136
    unit = s[0] / np.linalg.norm(s[0], axis=1, keepdims=True)
    block = R.relation_blocks(one).filter("i = 256 AND j = 512").first()
    assert np.allclose(block.cos, unit[256:512] @ unit[512:768].T)


def test_clips_are_taken_apart(spark):
    frames = [image(i, 2, 3).tobytes() for i in range(7)]
    rows = [("a", b"".join(frames), 3, 2), ("cut", frames[0][:-1], 3, 2), ("none", None, 3, 2), ("empty", b"", 3, 2), ("odd", frames[0], None, 2), ("minus", frames[0], -3, -2), (None, frames[1], 3, 2)]
    df = spark.createDataFrame(rows, "clip string, pixels binary, width int, height int")
    got = P.clip_frames(df, most=3, stride=2).collect()
    assert [(r.frame, bytes(r.pixels)) for r in sorted((r for r in got if r.clip == "a"), key=lambda r: r.frame)] == [(0, frames[0]), (1, frames[2]), (2, frames[4])]
    assert sorted((r.clip or "", r.frame) for r in got if r.clip != "a") == [("", 0)] and P.clip_frames(df).filter("clip = 'a'").count() == 7
    with pytest.raises(Exception, match="a clip is binary"):
        P.clip_frames(df.withColumn("pixels", df.clip))
