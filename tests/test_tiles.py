"""Tiles: the whole result across tile edges, frames read by bands, matching and similarity on large planes."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import kernels, tiles


def planes_of(row, names):
    return [np.frombuffer(row[n], "<u2").reshape(row["h"], row["w"]) for n in names]


def test_frame_of_twelve_megapixels(spark, tmp_path):
    """A raw file, read by bands and demosaiced by tiles, equals the frame done at once."""
    w, h = 4032, 3024
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1024, (h, w)).astype(np.int32)
    (tmp_path / "a.raw").write_bytes(kernels.write_samples(v.reshape(1, -1), "10.packed")[0].tobytes())
    cut = tiles.read_mosaics(spark, str(tmp_path), "pRAA", w, h)
    assert cut.count() == 6 * 8
    began = time.time()
    done = tiles.demosaic(cut, ["path"], "RGgB")
    sums = done.select(*[F.expr(f"crc32({c})").alias(c) for c in "rgb"], "ty", "tx").collect()
    took = time.time() - began
    assert w * h / took > 300_000  # ten times what interpreted column expressions do on one core
    want = kernels.demosaic(v, "RGgB")
    import zlib

    for r in sums:
        for c in "rgb":
            part = want[c][512 * r.ty : 512 * (r.ty + 1), 512 * r.tx : 512 * (r.tx + 1)]
            assert r[c] == zlib.crc32(np.ascontiguousarray(part, "<u2").tobytes())


@pytest.mark.parametrize(("w", "h", "size"), [(37, 29, 8), (8, 8, 3), (5, 1, 2), (16, 16, 64)])
def test_tiles_equal_the_whole(spark, w, h, size):
    rng = np.random.default_rng(2)
    images = [rng.integers(0, 256, (h, w)).astype(np.uint8) for _ in range(3)]
    df = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in enumerate(images)] + [(9, None)], "k int, v binary")
    got = tiles.assemble(tiles.demosaic(tiles.spread(tiles.cut(df, ["k"], ["v"], w, h, size=size), ["k"], 4), ["k"], "GBRg", adaptive=True), ["k"], list("rgb")).collect()
    assert sorted(r.k for r in got) == [0, 1, 2]
    for r in got:
        want = kernels.demosaic(images[r.k].astype(np.int32), "GBRg", True)
        assert all((a == want[c]).all() for a, c in zip(planes_of(r, "rgb"), "rgb", strict=True))


def test_values_without_python(spark):
    v = np.array([[0, 1, 255], [256, 65535, 4660]])
    df = spark.createDataFrame([(0, bytearray(v.astype("<u2").tobytes()))], "k int, v binary")
    cut = tiles.cut(df, ["k"], ["v"], 3, 2, depth=16, before=0, after=0)
    assert cut.select(tiles.values("v").alias("v")).first().v == v.ravel().tolist()
    with pytest.raises(Exception, match="not of 4 x 2 samples"):
        tiles.cut(df, ["k"], ["v"], 4, 2, depth=16).collect()


def slow_match(v, t):
    (h, w), (m, k) = v.shape, t.shape
    best = (-9, 0, 0)
    for y in range(h - m + 1):
        for x in range(w - k + 1):
            a, b = v[y : y + m, x : x + k].astype(float) - v[y : y + m, x : x + k].mean(), t - t.mean()
            e = (a * a).sum() * (b * b).sum()
            best = max(best, (round((a * b).sum() / e**0.5, 9) if e > 1e-9 else 0.0, -y, -x))
    return -best[1], -best[2], best[0]


@pytest.mark.parametrize("depth", [8, 16])
def test_match_on_small_frames(spark, depth):
    rng = np.random.default_rng(3)
    for h, w, m, k in ((9, 12, 3, 4), (20, 20, 5, 5), (6, 6, 6, 6)):
        v, t = rng.integers(0, 1 << depth, (h, w)), rng.integers(0, 1 << depth, (m, k))
        v[: h // 3] = 7  # flat windows
        assert (kernels.products(v, t) == [[(v[y : y + m, x : x + k] * t).sum() for x in range(w - k + 1)] for y in range(h - m + 1)]).all()
        y, x, s = kernels.best_place(v, t)
        assert (y, x) == slow_match(v, t)[:2] and abs(s - slow_match(v, t)[2]) < 1e-8


def test_match_in_a_megapixel(spark):
    """A 50 x 50 needle in 1000 x 1000, by tiles: found where it is, and its copy further down is not taken."""
    rng = np.random.default_rng(4)
    v = rng.integers(0, 256, (1000, 1000)).astype(np.uint8)
    v[900:950, 40:90] = v[480:530, 700:750]
    df = spark.createDataFrame([("a", bytearray(v.tobytes())), ("b", bytearray(v[::-1].copy().tobytes()))], "k string, v binary")
    cut = tiles.cut(df, ["k"], ["v"], 1000, 1000, size=256, before=0, after=49, edges=False)
    got = {r.k: (r.y, r.x, r.score) for r in tiles.match(cut, ["k"], v[480:530, 700:750].astype(np.int64)).collect()}
    assert got["a"] == (480, 700, 1.0) and got["b"][2] < 0.2


def test_similarity_by_tiles(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 256, (40, 52)).astype(np.uint8)
    b = np.clip(a.astype(int) + rng.integers(-20, 20, a.shape), 0, 255).astype(np.uint8)
    df = spark.createDataFrame([(0, bytearray(a.tobytes()), bytearray(b.tobytes())), (1, bytearray(a.tobytes()), bytearray(a.tobytes()))], "k int, a binary, b binary")
    cut = tiles.cut(df, ["k"], ["a", "b"], 52, 40, size=16, before=0, after=10, edges=False)
    got = {r.k: r.ssim for r in tiles.similarity(cut, ["k"], "a", "b").collect()}
    g = kernels.gaussian(11)
    w, values = np.outer(g, g), []
    for y in range(30):
        for x in range(42):
            p, q = a[y : y + 11, x : x + 11].astype(float), b[y : y + 11, x : x + 11].astype(float)
            mp, mq = (w * p).sum(), (w * q).sum()
            vp, vq, c = (w * p * p).sum() - mp * mp, (w * q * q).sum() - mq * mq, (w * p * q).sum() - mp * mq
            values.append((2 * mp * mq + 6.5025) * (2 * c + 58.5225) / ((mp * mp + mq * mq + 6.5025) * (vp + vq + 58.5225)))
    assert got[0] == pytest.approx(np.mean(values)) and got[1] == pytest.approx(1.0)
    small = tiles.similarity(tiles.cut(df, ["k"], ["a", "b"], 52, 40, size=16, before=0, after=0, edges=False), ["k"], "a", "b", size=17)
    assert {r.ssim for r in small.collect()} == {None}


def test_warp():
    v = np.arange(12).reshape(3, 4)
    assert (kernels.warp(v, [[1, 0, -1], [0, 1, 0]]) == [[0, 0, 1, 2], [0, 4, 5, 6], [0, 8, 9, 10]]).all()
    assert kernels.warp(v, [[1, 0, 0.5], [0, 1, 0.25]])[0, 0] == round(0.5 * (0 + 1) * 0.75 + 0.5 * (4 + 5) * 0.25)
