"""Parameter sets bit by bit, colour profiles in chunks, and tone curves."""

import base64

import pytest
from pyspark.sql import functions as F

from tessera.sources import hevc, icc, jpeg

#: A parameter set as an encoder writes it for 1280 x 720, 8 bits, level 3.1.
PUBLISHED = bytes.fromhex("42010101600000030090000003000003005da00280802d1659 59a4932b8040000003004000000782".replace(" ", ""))


def test_a_published_parameter_set():
    got = hevc.parse_sps(PUBLISHED)
    assert {k: got[k] for k in ("profile", "tier", "level", "chroma_format", "w", "h", "depth_luma", "depth_chroma", "sub_layers")} == {"profile": 1, "tier": 0, "level": 93, "chroma_format": 1, "w": 1280, "h": 720, "depth_luma": 8, "depth_chroma": 8, "sub_layers": 1}


def test_codes():
    r = hevc.Bits(bytes([0b10100110, 0b01000010, 0b10000000]))
    assert [r.ue() for _ in range(5)] == [0, 1, 2, 3, 4]
    assert [hevc.Bits(bytes([b])).se() for b in (0b10000000, 0b01000000, 0b01100000, 0b00100000)] == [0, 1, -1, 2]
    assert hevc.Bits(b"\0\0\3\1\0\0\3\0\0\3").size == 7 * 8
    with pytest.raises(ValueError):
        hevc.Bits(b"\0").ue()


def test_written_sets_are_read_back():
    for sub_layers in range(1, 8):
        for sets in ((), (1,), (3, 0, 2)):
            for chroma, units in ((0, (1, 1)), (1, (2, 2)), (2, (2, 1)), (3, (1, 1))):
                nal = hevc.write_sps(1920, 1088, 10, 2, 120, chroma, (1, 4), sub_layers, sets, (1, 9, 16, 9))
                got = hevc.parse_sps(nal)
                assert (got["w"], got["h"]) == (1920 - units[0], 1088 - 4 * units[1])
                assert (got["depth_luma"], got["sub_layers"], got["reference_sets"], got["fr"], got["cp"], got["tc"], got["mc"]) == (10, sub_layers, len(sets), 1, 9, 16, 9)
                assert b"\0\0\0" not in nal and b"\0\0\1" not in nal
                for cut in range(2, len(nal) - 4):
                    with pytest.raises(ValueError):
                        hevc.parse_sps(nal[:cut])


def test_sets_of_boxes(spark):
    good, plain = hevc.write_sps(64, 32, colour=(1, 1, 13, 5)), hevc.write_sps(16, 16)
    rows = [("a", hevc.write_box([(33, [plain, good])])), ("b", hevc.write_box([(33, [b"\x42\x01\x01"])])), ("c", hevc.write_box([(34, [b"\x44\x01"])])), ("d", b"no box"), ("e", None)]
    df = spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "path string, content binary")
    sets = {(r.path, r.idx): (r.sps.w, r.sps.mc, r.sps.error) for r in hevc.parameter_sets(hevc.nal_units(df)).collect()}
    assert sets == {("a", 0): (16, None, None), ("a", 1): (64, 5, None), ("b", 0): (None, None, "a parameter set ends early")}
    assert {r.path: r.meta for r in hevc.colorimetry(df).collect()} == {"a": {"hvcC:profile": 1, "hvcC:level": 93, "hvcC:fr": 1, "hvcC:cp": 1, "hvcC:tc": 13, "hvcC:mc": 5}}


def test_chunks():
    profile = icc.build({"rTRC": icc.sampled(), "cprt": b"text\0\0\0\0made here"})
    parts = [d[len(icc.PREFIX) :] for _, d in icc.to_chunks(profile, 60)]
    assert len(parts) == 4 and icc.from_chunks(parts[::-1]) == (profile, "ok")
    assert icc.from_chunks(parts[1:])[1] == "chunks 2, 3, 4 of 4" and icc.from_chunks([*parts, parts[0]])[1] == "chunks 1, 1, 2, 3, 4 of 4"
    assert icc.from_chunks([])[1] == "no profile" and icc.from_chunks([parts[0], b"\2\7x"])[1] == "chunks of different profiles" and icc.from_chunks([b"\1\1x"])[1] == "not a profile"


def test_profiles_of_files(spark):
    """One profile in three chunks, out of order, with other segments between."""
    utf16 = "Größe".encode("utf-16-be")
    described = b"mluc" + bytes(4) + (1).to_bytes(4, "big") + (12).to_bytes(4, "big") + b"deDE" + len(utf16).to_bytes(4, "big") + (28).to_bytes(4, "big") + utf16
    tags = {"desc": described, "dmnd": b"desc\0\0\0\0" + (5).to_bytes(4, "big") + b"name\0" + bytes(20), "rTRC": icc.parametric(3, 2.4, 0.5, -0.25, 0.125, 1.5), "gTRC": icc.sampled(0x0233), "bTRC": icc.sampled(0, 100, 65535), "kTRC": icc.sampled()}
    profile = icc.build(tags, (2, 1))
    a, b, c = icc.to_chunks(profile, -(-len(profile) // 3))
    rows = [("x", jpeg.build([(0xE0, b"JFIF\0\1\2\0\0\1\0\1\0\0"), c, (0xFE, b"ICC_PROFILE\0\1\1"), a, b])), ("y", jpeg.build([a, b])), ("z", b"")]
    found = icc.profiles(spark.createDataFrame([(p, bytearray(d)) for p, d in rows] + [("n", None)], "path string, content binary"))
    assert {r.path: r.status for r in found.collect()} == {"x": "ok", "y": "chunks 1, 2 of 3", "z": "no profile", "n": "no profile"}
    head = found.filter("path = 'x'").select(*[v.alias(k) for k, v in icc.header().items()]).first()
    assert (head.profile_version, head.profile_class, head.color_space, head.profile_connection_space) == ("2.1", "mntr", "RGB", "XYZ") and head.xyz_illuminant[1] == 1.0
    got = {r.tag: (r.v, r.t) for r in icc.tags(found).select("tag", icc.curve_values("data").alias("v"), icc.text_of("data").alias("t")).collect()}
    assert got["rTRC"][0] == [round(2.4 * 65536) / 65536, 0.5, -0.25, 0.125, 1.5]
    assert (got["gTRC"][0], got["bTRC"][0], got["kTRC"][0]) == ([0x233 / 256], [0.0, 100.0, 65535.0], [])
    assert (got["desc"][1], got["dmnd"][1], got["desc"][0]) == ("Größe", "name", None)


def test_curves_in_metadata(spark):
    said = "base64:" + base64.b64encode(icc.parametric(0, 2.5)).decode()
    df = spark.createDataFrame([(0, {"icc:red_trc": said, "icc:blue_trc": "base64:" + base64.b64encode(b"junk").decode(), "icc:green_trc": "plain", "exif:x": said}), (1, {}), (2, None)], "k int, m map<string,string>")
    got = {r.k: r.m for r in icc.decoded_curves(df, "m").select("k", "m").collect()}
    assert got == {0: {"icc:red_trc": "2.5", "icc:blue_trc": "", "icc:green_trc": "plain", "exif:x": said}, 1: {}, 2: None}
    assert df.select(F.col("m")).count() == 3
