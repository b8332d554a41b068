"""Baseline JPEG files to planes, and one schema for pixels of all kinds."""

import struct
import zlib

import numpy as np
import pytest

from tessera.sources import images, jpeg, jpeg_pixels


def smooth(rng, h, w):
    y, x = np.mgrid[:h, :w]
    return np.clip(128 + 60 * np.sin(x / 5 + rng.random()) + 40 * np.cos(y / 7) + rng.normal(0, 3, (h, w)), 0, 255).astype(np.int64)


@pytest.mark.parametrize(("sampling", "restart", "interleaved"), [([(1, 1)], 0, True), ([(1, 1)], 3, True), ([(1, 1)] * 3, 0, True), ([(2, 2), (1, 1), (1, 1)], 0, True), ([(2, 2), (1, 1), (1, 1)], 2, True), ([(2, 1), (1, 1), (1, 1)], 0, False), ([(1, 1)] * 4, 5, False)])
def test_generated_files(sampling, restart, interleaved):
    """Fine quantisation gives the planes back to within rounding."""
    rng = np.random.default_rng(1)
    for w, h in ((8, 8), (1, 1), (37, 29), (64, 16)):
        a, b = max(s[0] for s in sampling), max(s[1] for s in sampling)
        planes = [smooth(rng, -(-h * d // b), -(-w * c // a)) for c, d in sampling]
        data = jpeg_pixels.encode(planes, sampling, w, h, 1, restart, interleaved)
        got = jpeg_pixels.decode(data)
        assert (got["status"], got["w"], got["h"], got["depth"]) == ("ok", w, h, 8)
        assert list(got["planes"]) == list(jpeg_pixels.NAMES[len(planes)])
        for v, (back, pw, ph) in zip(planes, got["planes"].values(), strict=True):
            assert back.shape == v.shape == (ph, pw) and abs(back - v).max() <= 1


def test_against_the_formula():
    """Coefficients by hand: a flat block, one cosine, and a direct double sum."""
    rng = np.random.default_rng(2)
    c = rng.integers(-40, 40, (3, 64))
    c[0] = 0
    c[0, 0] = 8 * 17
    got = jpeg_pixels.inverse(c)
    assert (got[0] == 128 + 17).all()
    for n in range(3):
        for y in range(8):
            for x in range(8):
                f = sum((0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4 * c[n, 8 * v + u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8))
                assert got[n, y, x] == min(255, max(0, int(np.floor(f + 0.5 + 1e-7)) + 128))
    assert jpeg_pixels.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and jpeg_pixels.ZIGZAG[-3:].tolist() == [55, 62, 63]
    assert jpeg_pixels.codes([0, 1, 2], [5, 6, 7]) == [(2, 0, 5), (3, 2, 6), (3, 3, 7)]


def test_files_that_cannot_be_read():
    good = jpeg_pixels.encode([np.full((20, 20), 99)], [(1, 1)], 20, 20)
    said = lambda data: jpeg_pixels.decode(data)["status"]
    assert said(b"") == said(b"\xff\xd8\xff\xd9") == "no pixels"
    assert said(good.replace(b"\xff\xc0", b"\xff\xc2")) == "SOF2 of 8 bits is not read"
    assert said(good[: good.index(b"\xff\xda") + 12] + b"\xff\xd9") in ("coded data end early", "bits that are no code")
    no_codes = good[: good.index(b"\xff\xc4")] + good[good.index(b"\xff\xda") :]
    assert said(no_codes).startswith("a table that is not there")
    assert said(jpeg.build([(0xC4, bytes([0, 3] + [0] * 15 + [1, 2, 3]))])) == "more codes than their lengths allow"
    for k in range(2, len(good), 3):
        jpeg_pixels.decode(good[:k])
        broken = bytearray(good)
        broken[k] ^= 0x55
        jpeg_pixels.decode(bytes(broken))


def png(pixels):
    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + r.tobytes() for r in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_one_schema_for_all_kinds(spark, tmp_path):
    rng = np.random.default_rng(3)
    grey = smooth(rng, 10, 12)
    (tmp_path / "a.jpg").write_bytes(jpeg_pixels.encode([grey], [(1, 1)], 12, 10))
    (tmp_path / "b.jpeg").write_bytes(b"no file")
    (tmp_path / "c.y4m").write_bytes(b"YUV4MPEG2 W2 H2 F1:1 C420\nFRAME\n" + bytes(range(6)) + b"FRAME\n" + bytes(range(6, 12)))
    (tmp_path / "d.y4m").write_bytes(b"YUV4MPEG2 W2 H1 F1:1 Cmono10\nFRAME\n\1\2\3\1")
    rgb = rng.integers(0, 256, (3, 4, 3), dtype=np.uint8)
    (tmp_path / "e.png").write_bytes(png(rgb))
    (tmp_path / "f.txt").write_text("text")
    got = {(r.path.rsplit("/")[-1], r.frame_no): r for r in images.read_planes(spark, str(tmp_path)).collect()}
    assert {k: r.status for k, r in got.items()} == {("a.jpg", 0): "ok", ("b.jpeg", 0): "no pixels", ("c.y4m", 0): "ok", ("c.y4m", 1): "ok", ("d.y4m", 0): "ok", ("e.png", 0): "ok", ("f.txt", None): "no reader for .txt"}
    assert abs(np.array(got["a.jpg", 0].planes["y"].v) - grey.ravel()).max() <= 1
    assert {k: (p.v, p.w, p.h) for k, p in got["c.y4m", 1].planes.items()} == {"y": ([6, 7, 8, 9], 2, 2), "u": ([10], 1, 1), "v": ([11], 1, 1)}
    assert got["d.y4m", 0].depth == 10 and {k: p.v for k, p in got["d.y4m", 0].planes.items()} == {"y": [0x201, 0x103]}
    assert [got["e.png", 0].planes[c].v for c in "rgb"] == [rgb[..., k].ravel().tolist() for k in range(3)]
    assert images.read_planes(spark, str(tmp_path)).dtypes == spark.createDataFrame([], images.PLANES).dtypes
