"""Formulas against known vectors: colour, mosaics, packing, sampling, ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import colour, packing, ranges
from tessera.functions.sql import Spark
from tessera.operators import planes

RAMP = list(range(1, 17))


def plane(spark, values):
    return spark.createDataFrame([(0, list(values))], "image_id long, v array<int>")


def grid_of(df, column, w):
    return np.array(df.first()[column]).reshape(-1, w)


def hexed(text):
    return [int(text.replace(" ", "")[i : i + 2], 16) for i in range(0, len(text.replace(" ", "")), 2)]


def differences(spark, values):
    cell = planes.mosaic_planes(plane(spark, values), "RGgB", 4, 4)
    rows = planes.samples(cell.drop("v"), 2, r0="R0", g0="G0", g1="g1", b0="B0").orderBy("y", "x")
    parts = colour.mosaic_differences(Spark, "r0", "g0", "g1", "b0", 8)
    return rows.select(*[F.expr(e).alias(n) for n, e in zip(("Y", "D", "C", "k"), parts.values(), strict=True)]).collect()


def test_mosaic_differences(spark):
    got = differences(spark, hexed("00401030 80ff90f0 20203010 a0e0b0d0"))
    assert [[r[k] for r in got] for k in ("Y", "D", "C", "k")] == [hexed("6f707070"), hexed("a0b0c0d0"), hexed("00102030"), hexed("70707070")]


def test_mosaic_differences_of_a_ramp(spark):
    got = differences(spark, RAMP)
    assert [[r[k] for r in got] for k in ("Y", "D", "C", "k")] == [hexed("02040a0c"), hexed("81818181"), hexed("7d7d7d7d"), hexed("80808080")]


def test_bilinear_demosaic_and_yuv(spark):
    df = planes.demosaic(plane(spark, RAMP), "RGgB", 4, 4)
    row = df.first()
    assert row["r"] == hexed("01020303 05060707 090a0b0b 090a0b0b")
    assert row["g"] == hexed("03020304 05060707 090a0b0c 0d0d0f0d")
    assert row["b"] == hexed("06060708 06060708 0a0a0b0c 0e0e0f10")
    yuv = planes.samples(df.drop("v"), 4, r="r", g="g", b="b").orderBy("y", "x").select(*[F.expr(e).alias(n) for n, e in zip("luv", colour.rounded_yuv(Spark, ["r", "g", "b"]), strict=True)]).collect()
    assert [r["l"] for r in yuv] == hexed("03020304 05060707 090a0b0c 0c0c0e0d")
    assert [r["u"] for r in yuv] == hexed("81828282 80808080 80808080 81818081")
    assert [r["v"] for r in yuv] == hexed("7e80807f 80808080 8080807f 7d7e7d7e")
    u = planes.subsample(plane(spark, [r["u"] for r in yuv]), "420", 4, 4).first()["v"]
    v = planes.subsample(plane(spark, [r["v"] for r in yuv]), "420", 4, 4).first()["v"]
    assert (u, v) == (hexed("80818080"), hexed("7f7f7e7e"))


def test_other_orders_and_adaptive_green(spark):
    ramp0 = list(range(16))
    df = planes.demosaic(plane(spark, ramp0), "BGgR", 4, 4)
    row = df.first()
    assert row["r"] == [5, 5, 6, 7] * 2 + [9, 9, 10, 11, 13, 13, 14, 15]
    assert row["g"] == [2, 1, 2, 3, 4, 5, 6, 6, 8, 9, 10, 11, 12, 12, 14, 12]
    assert row["b"] == [0, 1, 2, 2, 4, 5, 6, 6] + [8, 9, 10, 10] * 2
    adaptive = planes.demosaic(plane(spark, ramp0), "BGgR", 4, 4, adaptive=True).first()["g"]
    assert adaptive == [1, 1, 2, 3, 4, 5, 6, 6, 8, 9, 10, 11, 12, 13, 14, 11]


def test_uniform_colour(spark):
    values = [200 if y % 2 == 0 and x % 2 == 0 else 50 if y % 2 and x % 2 else 100 for y in range(4) for x in range(4)]
    row = planes.demosaic(plane(spark, values), "BGgR", 4, 4).first()
    assert (set(row["r"]), set(row["g"]), set(row["b"])) == ({50}, {100}, {200})


@pytest.mark.parametrize(("depth", "rows"), [(8, [(255, 0, 0x00, 0x4C, 0x5B, 0xFF), (255, 0, 0x40, 0x54, 0x76, 0xFF), (255, 0, 0xFF, 0x69, 0xCA, 0xFF)]), (10, [(1023, 0, 0, 0x131, 0x169, 0x3FF), (1023, 0, 0x3FF, 0x1A6, 0x327, 0x3FF)])])
def test_rounded_yuv(spark, depth, rows):
    df = spark.createDataFrame([r[:3] for r in rows], "r int, g int, b int")
    got = df.select(*[F.expr(e).alias(n) for n, e in zip("yuv", colour.rounded_yuv(Spark, ["r", "g", "b"], depth), strict=True)]).collect()
    assert [tuple(r) for r in got] == [r[3:] for r in rows]


def test_stored_signed(spark):
    values = [-255, -128, -127, 0, 127, 128, 255]
    got = spark.createDataFrame([(v,) for v in values], "v int").select(F.expr(ranges.store_signed(Spark, "v", 8)).alias("s")).collect()
    assert [r.s for r in got] == [0, 64, 64, 128, 191, 192, 255]


def test_packed_ten_bit(spark):
    data = list(range(1, 21))
    c = packing.codec("10.packed")
    out = []
    for k in range(0, 20, 5):
        df = spark.createDataFrame([tuple(data[k : k + 5])], "b0 int, b1 int, b2 int, b3 int, b4 int")
        out += list(df.select(*[F.expr(e) for e in c.unpack(Spark, [f"b{i}" for i in range(5)])]).first())
    assert out == [0x005, 0x009, 0x00C, 0x010, 0x01A, 0x01E, 0x020, 0x024, 0x02F, 0x033, 0x034, 0x038, 0x040, 0x045, 0x049, 0x04C]


@pytest.mark.parametrize("name", list(packing.CODECS))
def test_packing_round_trip(spark, name):
    c = packing.codec(name)
    rng = np.random.default_rng(3)
    rows = [tuple(int(x) for x in r) for r in rng.integers(0, 1 << c.depth, (50, c.n_samples))]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} int" for i in range(c.n_samples)))
    packed = df.select("*", *[F.expr(e).alias(f"b{i}") for i, e in enumerate(c.pack(Spark, [f"c{i}" for i in range(c.n_samples)]))])
    back = packed.select(*[F.expr(e).alias(f"d{i}") for i, e in enumerate(c.unpack(Spark, [f"b{i}" for i in range(c.n_bytes)]))])
    assert [tuple(r) for r in back.collect()] == rows


def test_unsupported_packing():
    with pytest.raises(NotImplementedError):
        packing.codec("10.alaw")


def test_odd_subsampling(spark):
    values = [2 + 2 * x + 0x20 * y for y in range(5) for x in range(5)]
    got = planes.subsample(plane(spark, values), "420", 5, 5).first()["v"]
    assert got == hexed("13171a 53575a 83878a")
    back = planes.upsample(planes.subsample(plane(spark, values), "420", 5, 5), "420", 5, 5).first()["v"]
    assert np.array(back).reshape(5, 5).tolist()[0] == [0x13, 0x13, 0x17, 0x17, 0x1A]
    assert planes.subsample(plane(spark, values), "422", 5, 5).first()["v"][:3] == hexed("03070a")


@pytest.mark.parametrize("name", ["ycocgr"])
def test_lossless_colour(spark, name):
    rows = [(r, g, b) for r in (0, 1, 77, 255) for g in (0, 128, 254) for b in (3, 255)]
    df = spark.createDataFrame(rows, "r int, g int, b int")
    back = colour.convert(colour.convert(df, name), name, "yuv2rgb", ("c0", "c1", "c2"), ("x", "y", "z"))
    assert all((r.r, r.g, r.b) == (r.x, r.y, r.z) for r in back.collect())


@pytest.mark.parametrize("mc", [1, 4, 5, 6, 7, 9, 10, 11])
def test_matrix_round_trip(spark, mc):
    rows = [(r, g, b) for r in (0, 60, 255) for g in (10, 128, 250) for b in (3, 200)]
    df = spark.createDataFrame(rows, "r int, g int, b int")
    back = colour.convert(colour.convert(df, f"h273.{mc}"), f"h273.{mc}", "yuv2rgb", ("c0", "c1", "c2"), ("x", "y", "z"))
    assert all(abs(r.r - r.x) <= 3 and abs(r.g - r.y) <= 3 and abs(r.b - r.z) <= 4 for r in back.collect())


# Worked by hand from the equations, apart from the module's coefficients and expressions. Full-range chroma of H.273 stands at 255 * (x + 0.5), so around 127.5
# and not 128 as the standard's own integer form does (which gives 99, not 98, for the blue difference of red in number 1).
RED, WHITE, BLACK = (255, 0, 0), (255, 255, 255), (0, 0, 0)


@pytest.mark.parametrize(
    ("name", "rgb", "yuv"),
    [
        ("sdtv.computer", BLACK, (16, 128, 128)),
        ("sdtv.computer", RED, (81, 90, 239)),
        ("sdtv.computer", WHITE, (235, 128, 128)),
        ("hdtv.computer", BLACK, (16, 128, 128)),
        ("hdtv.computer", RED, (62, 102, 239)),
        ("ycocgr", RED, (63, 255, -127)),
        ("ycocgr", WHITE, (255, 0, 0)),
        ("h273.0", (10, 20, 30), (20, 30, 10)),
        ("h273.1", RED, (54, 98, 255)),
        ("h273.1", WHITE, (255, 128, 128)),
        ("h273.5", RED, (76, 84, 255)),
        ("h273.9", WHITE, (255, 128, 128)),
        ("unit", (10, 20, 30), (10, 20, 30)),
    ],
)
def test_colour_by_hand(spark, name, rgb, yuv):
    df = spark.createDataFrame([rgb], "r int, g int, b int")
    row = colour.convert(df, name, "rgb2yuv").first()
    assert (row["c0"], row["c1"], row["c2"]) == yuv
