"""Images of different sizes in one table, large planes, and buffers of any length."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import planes
from tessera.sources import jpeg, raw, y4m


def test_planes_of_different_sizes(spark):
    """One plan over several sizes gives what each size gives alone."""
    rng = np.random.default_rng(3)
    rows = [(k, h, w, rng.integers(0, 256, h * w).tolist()) for k, (h, w) in enumerate(((4, 6), (8, 8), (6, 2), (5, 7)))]
    table = spark.createDataFrame(rows, "image_id int, h int, w int, v array<int>")
    for operator in (
        lambda df, h, w: planes.rotate(df, 90, h, w), lambda df, h, w: planes.subsample(df, "420", h, w), lambda df, h, w: planes.decimate(df, h, w),
        lambda df, h, w: planes.upsample(planes.subsample(df, "422", h, w, out="c"), "422", h, w, column="c"),
        lambda df, h, w: planes.demosaic(df, "RGgB", h, w).withColumn("v", F.concat("r", "g", "b")), lambda df, h, w: planes.demosaic(df, "BGgR", h, w, adaptive=True).withColumn("v", F.col("g")),
        lambda df, h, w: planes.mosaic_planes(df, "GRBg", h, w).withColumn("v", F.concat("G0", "R0", "B0", "g1")),
    ):
        got = {r.image_id: r.v for r in operator(table, "h", "w").select("image_id", "v").collect()}
        for k, h, w, _ in rows:
            assert got[k] == operator(table.filter(F.col("image_id") == k), h, w).first().v
    long = planes.samples(table.select("image_id", "w", "v"), "w").collect()
    assert {(r.image_id, r.y, r.x): r.v for r in long} == {(k, p // w, p % w): x for k, _, w, v in rows for p, x in enumerate(v)}


def test_large_frame(spark):
    """A megapixel frame is read in time proportional to its bytes."""
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, 1_500_000, dtype=np.uint8).tobytes()
    content = b"YUV4MPEG2 W1000 H1000 F25:1 Ip A0:0 C420\nFRAME\n" + data
    got = y4m.planes(y4m.frames(spark.createDataFrame([("a", bytearray(content))], "path string, content binary"))).select("luma", "u", "v").first()
    want = np.frombuffer(data, np.uint8)
    assert (np.array(got.luma) == want[:1_000_000]).all() and (np.array(got.u) == want[1_000_000:1_250_000]).all() and (np.array(got.v) == want[1_250_000:]).all()


def test_values_of_buffers(spark):
    """Null, empty and odd buffers; both widths."""
    rows = [(0, bytearray(b"")), (1, None), (2, bytearray(b"\x01\xff\x03")), (3, bytearray(b"\x01\x02\x03\x04"))]
    df = spark.createDataFrame(rows, "k int, content binary").coalesce(1)
    got = {r.k: (r.a, r.b) for r in df.select("k", y4m.byte_values(F.col("content")).alias("a"), y4m.sample_values(F.col("content"), 10).alias("b")).collect()}
    assert got == {0: ([], []), 1: (None, None), 2: ([1, 255, 3], [0xFF01]), 3: ([1, 2, 3, 4], [0x0201, 0x0403])}
    assert {r.k for r in df.filter("k > 1").select("k", y4m.byte_values(F.col("content")).alias("a")).collect()} == {2, 3}
    wide = raw.rgba_planes(spark.createDataFrame([(bytearray(range(16)),)], "content binary"), "content", 2, 2).first()
    assert (wide.r, wide.g, wide.b) == ([0, 4, 8, 12], [1, 5, 9, 13], [2, 6, 10, 14])


def test_many_files_in_a_batch(spark):
    """More markers than are handed on at once."""
    data = jpeg.build([(0xFE, b"x" * 10)] * 300)
    files = spark.createDataFrame([(str(k), bytearray(data)) for k in range(100)], "path string, content binary").coalesce(1)
    found = jpeg.markers(files).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("m")).collect()
    assert len(found) == 100 and {(r.n, r.m) for r in found} == {(302, 301)}
