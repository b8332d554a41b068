"""Sources, sinks, parsers, filters and streams on small files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import formats, texts
from tessera.operators import blocks, metrics, pixels, planes, representations, results
from tessera.sources import hevc, jpeg, raw, video, y4m


def test_formats():
    assert len(formats.FORMATS) == 80 and len(formats.ALIASES) == 77
    assert formats.canonical("SRGGB10P").name == "pRAA" and formats.canonical("RG10").depth == 10
    with pytest.raises(ValueError):
        formats.canonical("none")


def test_stream_files_round_trip(spark, tmp_path):
    rows = [(k, f, [k * 20 + f + p for p in range(16)], [100 + f] * 4, [50 + k] * 4) for k in range(3) for f in range(2)]
    df = spark.createDataFrame(rows, "clip long, frame_no int, v array<int>, u array<int>, w array<int>")
    files = y4m.file_bytes(df, ["clip"], 4, 4, "420", ["v", "u", "w"], colorrange="full", extension={"EXTCS": "RG10"})
    video.write_whole(files.withColumn("name", F.concat("clip", F.lit(".y4m"))), "file://" + str(tmp_path))
    back = y4m.planes(y4m.read(spark, str(tmp_path))).orderBy("path", "frame_no").collect()
    assert [(r.luma, r.u, r.v, r.colorrange) for r in back] == [(v, u, w, "FULL") for _, _, v, u, w in rows]
    assert back[0].extension["EXTCS"] == "RG10"
    assert {r.extension for r in raw.metadata(spark, str(tmp_path)).collect()} == {".y4m"}


def test_streaming_frames(spark, tmp_path):
    from tessera.streaming.frames import frame_stream

    df = spark.createDataFrame([(0, f, [f] * 16) for f in range(3)], "clip long, frame_no int, v array<int>")
    video.write_whole(y4m.file_bytes(df, ["clip"], 4, 4, "mono", ["v"]).withColumn("name", F.lit("a.y4m")), str(tmp_path / "in"))
    query = frame_stream(spark, str(tmp_path / "in")).select("frame_no", F.octet_length("payload").alias("n")).writeStream.format("memory").queryName("frames_seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("frames_seen").collect()) == [(0, 16), (1, 16), (2, 16)]


def test_running_averages(spark, tmp_path):
    from tessera.streaming.frames import running_averages

    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 3.0), ("2024-01-01 01:10:00", "b", 5.0)], "t string, k string, v double").withColumn("t", F.to_timestamp("t"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = running_averages(stream, "t", ["k"], "v").writeStream.format("memory").queryName("means_seen").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r.k, r["mean"], r.n) for r in spark.table("means_seen").collect()) == [("a", 2.0, 2), ("b", 5.0, 1)]


def test_short_and_foreign_files(spark):
    df = spark.createDataFrame([("a", bytearray(b"YUV4MPEG2 W2 H2 F1:1 Cmono\nFRAME\n1234FRAME\n12")), ("b", bytearray(b"nothing")), ("c", bytearray(b"")), ("d", None)], "path string, content binary")
    got = y4m.frames(df).select("path", "frame_no", "payload").collect()
    assert [(r.path, r.frame_no, bytes(r.payload)) for r in got] == [("a", 0, b"1234")]


def test_raw_mosaic_files(spark, tmp_path):
    (tmp_path / "a.raw").write_bytes(bytes(range(1, 21)))
    got = raw.read_mosaics(spark, str(tmp_path), "pRAA", 4, 4).first()["samples"]
    assert got[:5] == [5, 9, 12, 16, 26] and len(got) == 16
    (tmp_path / "b.raw").write_bytes(b"1")
    with pytest.raises(Exception, match="not of 20 bytes"):
        raw.read_mosaics(spark, str(tmp_path), "pRAA", 4, 4).collect()


@pytest.mark.parametrize("codec", blocks.CODECS)
def test_block_codecs(codec):
    rng = np.random.default_rng(1)
    image = rng.choice([0, 255, 254, 1, 90], (10, 13), p=[0.4, 0.4, 0.05, 0.05, 0.1])
    image[:4, :8], image[4:8, :4] = 0, 255
    back = blocks.decode(blocks.encode(image, codec, 4), codec, 10, 13, 4, restore_white=False)
    if codec in ("warhol", "bitmap"):
        assert (back == image).all()
    elif codec == "warhol2":
        assert (back == np.where(image == 254, 255, np.where(image == 1, 0, image))).all()
    else:
        k = 8 - int(codec[-1])
        assert (back == (image >> k) << k).all()


def test_jpeg_markers(spark):
    data = jpeg.build([(0xE0, b"JFIF\0\1\2\0\0\1\0\1\0\0"), (0xDB, bytes([16] + [0, 7] * 64)), (0xC4, bytes([0, 1] + [0] * 15 + [9])), (0xDD, b"\0\4"), (0xDA, bytes([1, 1, 0x12, 0, 63, 0x21])), (0, b"ab\xff\0c\xff\xd0d"), (0xFE, b"hi")])
    rows = list(jpeg.scan(data))
    assert [r[1] for r in rows] == ["SOI", "APP0", "DQT", "DHT", "DRI", "SOS", "compressed_data", "COM", "EOI"]
    assert rows[2][4]["tables"][0]["Q"] == [7] * 64 and rows[3][4]["tables"][0]["V"][0] == [9]
    assert rows[5][4]["approximation"] == [2, 1] and rows[6][3] == 8
    found = jpeg.markers(spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(data[:30])), ("c", None)], "path string, content binary"))
    assert found.filter("path = 'a'").count() == 9 and found.filter("path = 'c'").count() == 0
    assert json.loads(jpeg.extract(found, "COM").first()["contents"]) == {"comment": "hi"}


def test_jpeg_ls():
    data = jpeg.build([(0xF7, bytes([8, 0, 1, 0, 1, 1, 1, 0x11, 0])), (0xF8, bytes([1, 0, 255, 0, 3, 0, 7, 0, 21, 0, 64])), (0xDA, bytes([1, 1, 0, 0, 0, 0])), (0, b"x\xff\x7fy")])
    rows = list(jpeg.scan(data))
    assert [r[1] for r in rows] == ["SOI", "SOF55", "LSE", "SOS", "compressed_data", "EOI"] and rows[2][4]["MAXVAL"] == 255


def test_hevc_box():
    nal = b"\x42\x01"
    body = bytes([1, 0x61]) + bytes(4) + bytes(6) + bytes([93, 0xF0, 0, 0xFC, 0xFD, 0xFA, 0xF8, 0, 25, 0x0F, 1, 33, 0, 1, 0, 2]) + nal
    fields, units = hevc.parse_hvcc((len(body) + 8).to_bytes(4, "big") + b"hvcC" + body)
    assert fields["profile"] == 1 and fields["depth_luma"] == 10 and units == [(33, 0, nal)]
    with pytest.raises(ValueError):
        hevc.parse_hvcc(b"\0\0\0\1abcd")


def test_time_report(spark):
    text = "\tCommand being timed: \"ls\"\n\tUser time (seconds): 1.25\n\tSystem time (seconds): 0.50\n\tPercent of CPU this job got: 97%\n\tElapsed (wall clock) time (h:mm:ss or m:ss): 2:03.50\n\tSwaps: 0\n"
    f = texts.gnu_time(F.col("t"))
    row = spark.createDataFrame([(text,)], "t string").select(*[v.alias(k) for k, v in f.items()]).first()
    assert (row.usersystemtime, row.cpu, row.elapsed, row.swaps, row.maxrss) == (1.75, 97.0, 123.5, 0, None)


def test_affine_and_noise(spark):
    df = spark.createDataFrame([(0, list(range(64)))], "image_id long, v array<int>")
    half = pixels.affine(df, [[1, 0, 0.5], [0, 1, 0]], 8, 8).first()["v"]
    assert half[1:4] == [0, 2, 2] and half[0] == 0
    long = planes.samples(df)
    noisy = pixels.noise(long, 5).withColumnRenamed("v", "n").join(long, ["image_id", "y", "x"])
    assert noisy.filter("abs(n - v) > 5").count() == 0 and noisy.filter("n <> v").count() > 30


def test_metrics_of_equal_images(spark):
    df = spark.createDataFrame([(0, 0, x, 7, 7) for x in range(4)], "image_id long, y int, x int, a int, b int")
    assert metrics.psnr(df, ["image_id"]).first()["psnr"] == float("inf")
    assert metrics.ssim(df, ["image_id"]).first()["ssim"] == 1.0


def test_averages_leave_out_missing_values(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "x", float("nan")), ("c", "x", None), ("d", "y", 4.0)], "infile string, codec string, psnr double")
    got = {r.codec: (r.infile, r.psnr) for r in results.averages(df, ["codec"], ["psnr"]).collect()}
    assert got == {"x": ("average", 1.0), "y": ("average", 4.0)}


def test_convert_and_read_by_kind(spark, tmp_path):
    from tessera.sources import images

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.raw").write_bytes(bytes(range(1, 21)))
    representations.convert_files(spark, str(tmp_path / "in"), "pRAA", 4, 4, "bayer_rggb16le", str(tmp_path / "out"))
    data = (tmp_path / "out" / "a.raw").read_bytes()
    assert [int.from_bytes(data[i : i + 2], "little") for i in range(0, 8, 2)] == [5 << 6, 9 << 6, 12 << 6, 16 << 6]
    rgb = images.demosaiced(spark, str(tmp_path / "in"), "pRAA", 4, 4).first()
    assert len(rgb["r"]) == 16 and rgb["r"][0] == 5
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.jpg").write_bytes(jpeg.build([(0xFE, b"x")]))
    assert images.read(spark, str(tmp_path / "j"), ".jpg").count() == 3
    df = spark.createDataFrame([(0, 0, [1] * 16)], "clip long, frame_no int, v array<int>")
    images.write_streams(df, str(tmp_path / "j"), "clip", 4, 4, "mono", ["v"], colorrange="limited")
    assert images.read(spark, str(tmp_path / "j"), ".y4m").count() == 1
    assert {r.range for r in images.colour_range(spark, str(tmp_path / "j")).collect()} == {"full", "limited"}
    with pytest.raises(ValueError):
        images.read(spark, str(tmp_path), ".xyz")


def test_convert_colour_files(spark, tmp_path):
    """Planes of red, green and blue to luma and chroma, as the conversion of single samples gives them."""
    from tessera.functions import colour
    from tessera.sources import images

    (tmp_path / "in").mkdir()
    r, g, b = [10, 200, 0, 255], [20, 100, 0, 255], [30, 50, 255, 255]
    (tmp_path / "in" / "a.rgb").write_bytes(bytes(r + g + b))
    images.convert_colour_files(spark, str(tmp_path / "in"), 2, 2, str(tmp_path / "out"))
    want = colour.convert(spark.createDataFrame(list(zip(range(4), r, g, b, strict=True)), "k int, r int, g int, b int")).orderBy("k").collect()
    assert (tmp_path / "out" / "a.rgb").read_bytes() == bytes([x[c] for c in ("c0", "c1", "c2") for x in want])
    with pytest.raises(ValueError):
        images.convert_colour_files(spark, str(tmp_path / "in"), 2, 2, str(tmp_path / "o"), target="yuv420p8")


def test_inner_border_demosaic(spark):
    df = spark.createDataFrame([(0, list(range(16)))], "image_id long, v array<int>")
    row = planes.demosaic_inner(df, "BGgR", 4, 4).first()
    want = [5, 5, 6, 6] * 2 + [9, 9, 10, 10] * 2
    assert row["r"] == row["g"] == row["b"] == want
