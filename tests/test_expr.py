"""Scalar rules and their traps."""

import math

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import arrays as A
from lumenframe.functions import expr as E


def one(spark, column, ddl="x double", *values):
    return spark.createDataFrame([tuple(values) or (0.0,)], ddl).select(column.alias("v")).first().v


@pytest.mark.parametrize("x, want", [(float("nan"), 0.0), (-1.0, 0.0), (2.0, 1.0), (0.25, 0.25), (float("inf"), 1.0)])
def test_clamp(spark, x, want):
    assert one(spark, E.clamp01(F.col("x")), "x double", x) == want


def test_bare_clamp_takes_nan_as_large(spark):
    assert one(spark, E.bare_clamp01(F.col("x")), "x double", float("nan")) == 1.0


@pytest.mark.parametrize("x, want", [(None, None), ("", None), ("nan", None), ("abc", None), ("inf", math.inf), ("1.5", 1.5)])
def test_safe_float(spark, x, want):
    assert one(spark, E.safe_float(F.col("x")), "x string", x) == want


@pytest.mark.parametrize("x, want", [(5.0, "5s"), (184.0, "3m04s"), (3720.0, "1h02m"), (-1.0, "unknown"), (float("nan"), "unknown"), (None, "unknown"), (0.5, "0s"), (1.5, "2s")])
def test_eta(spark, x, want):
    assert one(spark, E.eta_text(F.col("x")), "x double", x) == want


@pytest.mark.parametrize("x, want", [("30000/1001", 30000 / 1001), ("25", 25.0), ("1/0", None), ("a/b", None)])
def test_ratio(spark, x, want):
    got = one(spark, E.ratio(F.col("x")), "x string", x)
    assert got == want if want is None else got == pytest.approx(want)


def test_bool_from_text(spark):
    assert one(spark, E.bool_from_text(F.col("x")), "x string", " Yes ") is True
    assert one(spark, E.bool_from_text(F.col("x")), "x string", "off") is False
    with pytest.raises(Exception, match="not a truth value"):
        one(spark, E.bool_from_text(F.col("x")), "x string", "maybe")


def test_first_match_takes_the_first_rule(spark):
    rules = {"a": ["x", "y"], "b": ["y"]}
    assert one(spark, E.first_match(F.col("x"), rules), "x string", "/Y/") == "a"
    assert one(spark, E.first_match(F.col("x"), rules), "x string", None) == "unknown"


def test_hash_fraction_like_hashlib(spark):
    import hashlib

    for k in ("a", "sample_17", ""):
        assert one(spark, E.hash_fraction(F.col("x")), "x string", k) == int(hashlib.sha1(k.encode()).hexdigest()[:8], 16) / 0xFFFFFFFF


def test_uri(spark):
    u = "hdf5:///a/b.h5::k::z"
    assert one(spark, E.hdf5_file(F.col("x")), "x string", u) == "/a/b.h5"
    assert one(spark, E.hdf5_key(F.col("x")), "x string", u) == "k::z"
    assert one(spark, E.uri_scheme(F.col("x")), "x string", "/a") == "file"


@pytest.mark.parametrize("n, want", [(1, [0]), (81, [0]), (80, [0]), (162, [0, 81]), (200, [0, 81, 119])])
def test_window_starts(spark, n, want):
    assert one(spark, A.window_starts(F.col("x"), 81, 0), "x int", n) == want


def test_uniform_frames_like_numpy(spark):
    import numpy as np

    for n, k in ((1, 4), (101, 49), (17, 1), (60, 81), (7, 7)):
        want = [0] if k == 1 else np.linspace(0, n - 1, k).round().astype(int).tolist()
        assert one(spark, A.uniform_frames(F.col("x"), k), "x int", n) == want


def test_pad_or_cut(spark):
    assert one(spark, A.pad_or_cut(F.col("x"), 4), "x array<int>", [1, 2]) == [1, 2, 2, 2]
    assert one(spark, A.pad_or_cut(F.col("x"), 2), "x array<int>", [1, 2, 3]) == [1, 2]
    assert one(spark, A.pad_or_cut(F.col("x"), 2), "x array<int>", []) == []


def test_pooling_overlaps(spark):
    got = one(spark, A.pooled(F.col("x"), F.size("x"), 2), "x array<array<double>>", [[1.0], [2.0], [6.0]])
    assert got == [[1.5], [4.0]]


def test_resampling(spark):
    assert one(spark, A.resampled(F.col("x"), F.size("x"), 4), "x array<array<double>>", [[0.0], [1.0]]) == [[0.0], [0.25], [0.75], [1.0]]
