"""Formulas against what the standards say, worked out in exact fractions and without the tables of coefficients that the library uses."""

from fractions import Fraction as Q

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import colour, packing, ranges
from tessera.functions.sql import Spark

#: Weights of red and blue: Rec. 601 and Rec. 709.
WEIGHTS = {"sdtv": (Q("0.299"), Q("0.114")), "hdtv": (Q("0.2126"), Q("0.0722"))}


def pixels(n=250, seed=1):
    v = np.random.default_rng(seed).integers(0, 256, (n, 3)).tolist()
    return [*v, [0, 0, 0], [255, 255, 255], [255, 0, 0], [0, 255, 0], [0, 0, 255], [1, 254, 128]]


def luma_chroma(p, kr, kb):
    """Luma from 0 to 1 and chroma from -1/2 to 1/2 of red, green, blue from 0 to 1."""
    r, g, b = p
    y = kr * r + (1 - kr - kb) * g + kb * b
    return y, (b - y) / (2 * (1 - kb)), (r - y) / (2 * (1 - kr))


def away(x):
    return int(x + Q(1, 2)) if x >= 0 else -int(-x + Q(1, 2))


def clip(x, low=0, high=255):
    return min(high, max(low, x))


def converted(spark, name, direction, rows):
    df = spark.createDataFrame(rows, "a int, b int, c int")
    return [tuple(r) for r in df.select(*[F.expr(e).alias(f"c{k}") for k, e in enumerate(colour.convert_sql(Spark, name, direction, ["a", "b", "c"]))]).collect()]


@pytest.mark.parametrize("mc", [1, 4, 5, 6, 7, 9, 10])
def test_h273(spark, mc):
    """Full range, by the definition of luma and colour differences; a product may fall on either side of a half."""
    kr, kb = {1: ("0.2126", "0.0722"), 4: ("0.30", "0.11"), 5: ("0.299", "0.114"), 6: ("0.299", "0.114"), 7: ("0.212", "0.087"), 9: ("0.2627", "0.0593"), 10: ("0.2627", "0.0593")}[mc]
    rows = pixels()
    near = lambda x: {clip(away(x - Q(1, 10**9))), clip(away(x + Q(1, 10**9)))}
    for got, p in zip(converted(spark, f"h273.{mc}", "rgb2yuv", rows), rows, strict=True):
        y, u, v = luma_chroma([Q(x, 255) for x in p], Q(kr), Q(kb))
        assert got[0] in near(255 * y) and got[1] in near(255 * (u + Q(1, 2))) and got[2] in near(255 * (v + Q(1, 2)))
    for got, (l, cb, cr) in zip(converted(spark, f"h273.{mc}", "yuv2rgb", rows), rows, strict=True):
        y, u, v = Q(l, 255), Q(cb, 255) - Q(1, 2), Q(cr, 255) - Q(1, 2)
        r, b = y + 2 * (1 - Q(kr)) * v, y + 2 * (1 - Q(kb)) * u
        g = (y - Q(kr) * r - Q(kb) * b) / (1 - Q(kr) - Q(kb))
        assert all(x in near(255 * e) for x, e in zip(got, (r, g, b), strict=True))


@pytest.mark.parametrize("name", ["sdtv.analog", "sdtv.digital", "sdtv.computer", "hdtv.analog", "hdtv.digital", "hdtv.computer"])
def test_rounded_matrices_follow_their_standard(spark, name):
    """Published matrices of three places stay within two levels of the exact conversion, which a wrong coefficient leaves."""
    kr, kb = WEIGHTS[name.split(".")[0]]
    rows = pixels()
    for got, p in zip(converted(spark, name, "rgb2yuv", rows), rows, strict=True):
        y, u, v = luma_chroma([Q(x, 255) for x in p], kr, kb)
        full = name.endswith("analog")
        want = (255 * y, 128 + 255 * u, 128 + 255 * v) if full else (16 + 219 * y, 128 + 224 * u, 128 + 224 * v)
        assert all(abs(float(g) - float(w)) <= 2.6 for g, w in zip(got, want, strict=True)), (p, got)


def test_basic_matrices(spark):
    """U and V of the analogue standard: 0.492 (B - Y) and 0.877 (R - Y), cut at 0."""
    for name in ("sdtv.basic", "hdtv.basic"):
        kr, kb = WEIGHTS[name[:4]]
        rows = pixels()
        for got, p in zip(converted(spark, name, "rgb2yuv", rows), rows, strict=True):
            y, u, v = luma_chroma(p, kr, kb)
            assert all(abs(g - clip(float(w))) <= 1.6 for g, w in zip(got, (y, Q("0.872") * u, Q("1.23") * v), strict=True))


def test_lossless_and_identity(spark):
    rows = pixels(400)
    there = converted(spark, "ycocgr", "rgb2yuv", rows)
    assert converted(spark, "ycocgr", "yuv2rgb", there) == [tuple(p) for p in rows]
    assert converted(spark, "unit", "rgb2yuv", rows) == [tuple(p) for p in rows]
    for mc in (0,):
        assert converted(spark, f"h273.{mc}", "yuv2rgb", converted(spark, f"h273.{mc}", "rgb2yuv", rows)) == [tuple(p) for p in rows]


@pytest.mark.parametrize("name", list(packing.CODECS))
def test_packing_bit_by_bit(spark, name):
    """Samples to bytes by writing out their bits: upper bits a byte each, then the low bits of all, the first sample's last."""
    c = packing.CODECS[name]
    v = np.random.default_rng(2).integers(0, 1 << c.depth, (60, c.n_samples)).tolist()
    df = spark.createDataFrame(v, ", ".join(f"c{k} int" for k in range(c.n_samples)))
    got = [list(r) for r in df.select(*[F.expr(e).alias(f"b{k}") for k, e in enumerate(c.pack(Spark, [f"c{k}" for k in range(c.n_samples)]))]).collect()]
    for row, out in zip(v, got, strict=True):
        bits = [format(x, f"0{c.depth}b") for x in row]
        if name == "8":
            want = row
        elif ".packed" in name:
            low = "".join(b[8:] for b in bits[::-1])
            want = [int(b[:8], 2) for b in bits] + [int(low[k : k + 8], 2) for k in range(0, len(low), 8)][::-1]
        else:
            want = [x for b in bits for x in ((int(b.zfill(16)[:8], 2), int(b.zfill(16)[8:], 2)) if name == "16be" else (int(b.zfill(16)[8:], 2), int(b.zfill(16)[:8], 2)))]
        assert out == want


def half_even(x):
    low = x.numerator // x.denominator
    rest = x - low
    return low + (rest > Q(1, 2) or (rest == Q(1, 2) and low % 2 == 1))


@pytest.mark.parametrize(("source", "target"), [((0, 255), (16, 235)), ((16, 235), (0, 255)), ((16, 240), (0, 255)), ((0, 1023), (64, 940)), ((64, 960), (0, 1023))])
def test_ranges(spark, source, target):
    """Every sample by the line through both ends, in fractions; where a double lands beside a half, either side."""
    top = 255 if max(source + target) < 256 else 1023
    value, broken = ranges.rescale(Spark, "v", source, target)
    got = spark.range(top + 1).select(F.col("id").cast("int").alias("v")).select("v", F.expr(value).alias("w"), F.expr(broken).alias("b")).collect()
    for r in got:
        x = Q(r.v - source[0], source[1] - source[0]) * (target[1] - target[0]) + target[0]
        sides = {half_even(x), half_even(x - Q(1, 10**9)), half_even(x + Q(1, 10**9))}
        assert r.w in {clip(e, *target) for e in sides} and r.b in {not target[0] <= e <= target[1] for e in sides}
