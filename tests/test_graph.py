"""Conversions between all formats, kernels against the column expressions they replace, and experiments as a user runs them."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import colour, formats, packing
from tessera.functions.sql import Spark
from tessera.operators import experiments, kernels, planes, representations

READABLE = [f for f in formats.FORMATS.values() if f.codec not in packing.UNSUPPORTED]


def test_every_pair_of_formats():
    """Any two of the formats convert, to a buffer of the right size; those that cannot be read raise."""
    rng = np.random.default_rng(1)
    for a, b in itertools.product(READABLE, READABLE):
        p = {c: rng.integers(0, 1 << a.depth, (2, *shape)).astype(np.int32) for c, shape in kernels.plane_shapes(a, 16, 8).items()}
        raw = kernels.write_buffer(p, a)
        assert raw.shape == (2, representations.buffer_size(a, 16, 8))
        back = kernels.read_buffer(raw, a, 16, 8)
        assert all((back[c] == p[c]).all() for c in p)
        out = representations.run_plan(raw, a, b, representations.planes_plan(a, b), 16, 8)
        assert out.shape == (2, representations.buffer_size(b, 16, 8)), (a.name, b.name)
        if a.name == b.name:
            assert (out == raw).all()
    for f in formats.FORMATS.values():
        if f not in READABLE:
            with pytest.raises(NotImplementedError):
                representations.planes_plan(f, READABLE[0])


def test_routes():
    assert representations.route("yuv", "ydgcocg") == [("yuv", "rgb"), ("rgb", "bayer"), ("bayer", "ydgcocg")]
    assert representations.route("rgb", "rgb") == []
    with pytest.raises(ValueError):
        representations.route("rgb", "none")
    assert representations.plan("SRGGB10P", "yuv420p8") == ["unpack pRAA", "depth 10 to 8", "demosaic RGgB", "yuv", "chroma down 420", "pack yuv420p8"]
    assert representations.plan("yuv422p10", "yuv444p10") == ["unpack yuv422p10", "chroma up 422", "pack yuv444p10"]
    assert representations.plan("bayer_rggb8", "bayer_bggr8") == ["unpack bayer_rggb8", "pack bayer_bggr8"]


def test_colours_equal_their_sql(spark):
    """The kernels' colour steps against the SQL of the same names, over all depths."""
    rng = np.random.default_rng(2)
    for depth in (8, 10, 12, 16):
        top = (1 << depth) - 1
        v = np.concatenate([rng.integers(0, top + 1, (300, 3)), [[0, 0, 0], [top, top, top], [top, 0, 0], [0, 0, top]]])
        df = spark.createDataFrame(v.tolist(), "a int, b int, c int")
        cut = lambda names: {k: v[:, i].astype(np.int32)[None] for i, k in enumerate(names)}  # noqa: E731, B023
        for names, sql, kernel in (("rgb", colour.rounded_yuv, kernels.to_yuv), ("yuv", colour.rounded_rgb, kernels.to_rgb)):
            want = [tuple(r) for r in df.select(*[F.expr(e).cast("int") for e in sql(Spark, ["a", "b", "c"], depth)]).collect()]
            assert list(zip(*[x[0].tolist() for x in kernel(cut(names), depth).values()], strict=True)) == want
        m = {k: v[:, i % 3].astype(np.int32)[None] for i, k in enumerate("RGgB")}
        want = [tuple(r) for r in df.select(*[F.expr(e) for e in colour.mosaic_differences(Spark, "a", "b", "c", "a", depth).values()]).collect()]
        got = kernels.to_differences(m, depth)
        assert list(zip(*[got[k][0].tolist() for k in "YDCc"], strict=True)) == want
        d = {k: v[:, i % 3].astype(np.int32)[None] for i, k in enumerate("YDCc")}
        sql = colour.mosaic_from_differences(Spark, "a", "b", "c", "a", depth)
        want = [tuple(r) for r in df.select(*[F.expr(sql[k]) for k in "RGgB"]).collect()]
        assert list(zip(*[kernels.from_differences(d, depth)[k][0].tolist() for k in "RGgB"], strict=True)) == want


def test_packing_equals_its_sql(spark):
    rng = np.random.default_rng(3)
    for name, c in packing.CODECS.items():
        raw = rng.integers(0, 256, (50, c.n_bytes)).astype(np.uint8)
        df = spark.createDataFrame(raw.tolist(), ", ".join(f"b{i} int" for i in range(c.n_bytes)))
        want = [list(r) for r in df.select(*[F.expr(e) for e in c.unpack(Spark, [f"b{i}" for i in range(c.n_bytes)])]).collect()]
        assert kernels.read_samples(raw, name).tolist() == want, name


def slow_demosaic(v, order):
    """One sample at a time."""
    h, w = v.shape
    out = {c: np.zeros((h, w), int) for c in "rgb"}
    for y, x in itertools.product(range(h), range(w)):
        for c in "rgb":
            of = lambda y, x, c=c: order[(y % 2) * 2 + x % 2].lower() == c
            near = [(min(h - 1, max(0, y + dy)), min(w - 1, max(0, x + dx))) for dy, dx in kernels.AROUND]
            own = [v[p] for p in near if of(*p)]
            out[c][y, x] = v[y, x] if of(y, x) else sum(own) // len(own)
    return out


def test_demosaic_one_sample_at_a_time(spark):
    rng = np.random.default_rng(4)
    for order, (h, w) in itertools.product(("RGgB", "GBRg"), ((2, 2), (5, 7), (8, 6))):
        v = rng.integers(0, 1024, (h, w))
        want = slow_demosaic(v, order)
        got = planes.demosaic(spark.createDataFrame([(v.ravel().tolist(),)], "v array<int>"), order, h, w).first()
        assert all(got[c] == want[c].ravel().tolist() for c in "rgb")


def test_convert_table(spark):
    """Sizes from columns, null buffers, and a wrong size."""
    rows = [(0, 4, 4, bytearray(range(16))), (1, 8, 2, bytearray(range(16))), (2, 4, 4, None)]
    df = spark.createDataFrame(rows, "k int, w int, h int, content binary")
    got = {r.k: r.content for r in representations.convert(df, "bayer_rggb8", "RG10", "w", "h").collect()}
    assert bytes(got[0]) == b"".join((4 * k).to_bytes(2, "little") for k in range(16)) == bytes(got[1]) and got[2] is None
    back = representations.convert(representations.convert(df, "bayer_rggb8", "bayer_gbrg16be", "w", "h"), "GBRG16BE" if "GBRG16BE" in formats.ALIASES else "bayer_gbrg16be", "bayer_rggb8", "w", "h")
    assert {r.k: r.content and bytes(r.content) for r in back.collect()} == {k: c and bytes(c) for k, _, _, c in rows}
    with pytest.raises(Exception, match="a buffer of 16 bytes, not 64"):
        representations.convert(df, "bayer_rggb8", "RG10", 8, 8).collect()


def test_convert_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rng = np.random.default_rng(5)
    raw = rng.integers(0, 256, 64 * 10 // 8, dtype=np.uint8)
    (tmp_path / "in" / "a.raw").write_bytes(raw.tobytes())
    representations.convert_files(spark, str(tmp_path / "in"), "pRAA", 8, 8, "yuv420p10", str(tmp_path / "out"))
    a, b = formats.canonical("pRAA"), formats.canonical("yuv420p10")
    want = representations.run_plan(raw[None], a, b, representations.planes_plan(a, b), 8, 8)
    assert (tmp_path / "out" / "a.raw").read_bytes() == want.tobytes()


def test_experiments_of_a_user(spark):
    """A codec of one's own, an experiment of one's own, and failures as rows."""
    rng = np.random.default_rng(6)
    rows = [(f"f{k}", bytearray(rng.integers(0, 256, 64, dtype=np.uint8).tobytes())) for k in range(5)] + [("short", bytearray(b"123")), ("none", None)]
    df = spark.createDataFrame(rows, "infile string, content binary")

    def halves(p, depth, quality):
        if quality == 13:
            raise ValueError("no such quality")
        return {k: v // 2 * 2 for k, v in p.items()}, {k: 1 for k in p}

    got = experiments.run(df, "GRBG", 8, 8, ["bayer-planar", "rgb"], experiments.Options(codec=halves, qualities=(1, 13))).collect()
    failed = {(r.infile, r.approach, r.quality, r.error) for r in got if r.error}
    assert {(i, q) for i, _, q, _ in failed} == {(f"f{k}", 13.0) for k in range(5)} | {(i, q) for i in ("short", "none") for q in (1.0, 13.0)}
    assert {e for i, _, _, e in failed if i.startswith("f")} == {"ValueError: no such quality"}
    fine = [r for r in got if not r.error and r.infile != "average"]
    assert {(r.encoded_size, r.encoded_size_breakdown) for r in fine if r.approach == "rgb"} == {(3, "1:1:1")}
    for r in fine:
        if r.approach == "bayer-planar":
            v = np.frombuffer(bytes(dict(rows)[r.infile]), np.uint8).astype(int)
            assert r.psnr_bayer == pytest.approx(10 * np.log10(255**2 / np.mean((v - v // 2 * 2) ** 2)))
    means = [r for r in got if r.infile == "average"]
    assert {(r.approach, r.quality) for r in means} == {("bayer-planar", 1.0), ("rgb", 1.0)}
    infinite = experiments.run(df.limit(1), "GRBG", 8, 8, ["bayer-packed"], experiments.Options(qualities=(1,), infinity=True, averages=False)).first()
    assert infinite.psnr_bayer == infinite.psnr_yuv == float("inf") and infinite.encoded_size == 64
    with pytest.raises(ValueError):
        experiments.run(df, "yuv420p8", 8, 8)
