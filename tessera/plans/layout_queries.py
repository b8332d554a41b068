"""Queries over memory layouts, joins by place, and the writers' bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import colour, ranges, texts
from ..functions.sql import Duck, Spark
from ..operators import blocks, kernels, metrics, pixels, planes, results
from ..sources import jpeg, y4m
from ..sources.folders import dealt
from . import table_queries as tq
from .image_queries import cells, demosaiced, long_plane
from .registry import register

PIXEL = ["image_id", "y", "x"]


def listed(df: DataFrame, column: str) -> DataFrame:
    """image_id, p, v: an array as rows."""
    return df.select("image_id", F.posexplode(column).alias("p", "v"))


def mosaic_planes(s, d) -> DataFrame:
    return planes.mosaic_planes(planes.planes(s, d).drop("label"), "RGgB").drop("v")


# ---- buffers ----

register("pck10_planar_buffer", lambda s, d: listed(mosaic_planes(s, d).withColumn("b", F.concat("R0", "G0", "g1", "B0")), "b"), "SELECT image_id, CAST(((y % 2) * 2 + x % 2) * 16 + (y // 2) * 4 + x // 2 AS INT) AS p, v FROM plane", "plane")
register("pck14_planar_16bit", lambda s, d: planes.planes(s, d, 10).withColumn("b", y4m.pack_samples("v", 10)).select("image_id", F.octet_length("b").alias("n"), F.hex("b").alias("bytes")), "SELECT image_id, 128 AS n, string_agg(printf('%02X%02X', v & 255, v >> 8), '' ORDER BY y, x) AS bytes FROM plane10 GROUP BY image_id", "plane10")


def differences_420(s, d) -> DataFrame:
    """Luma and green difference planes, then rows of orange beside green at a quarter."""
    f = tq._forward(Spark)
    c = cells(s, d).select("image_id", "y", "x", *[F.expr(v).alias(k) for k, v in f.items()])
    place = "4 * y + x"
    small = "16 * 2 + (y div 2) * 4 + x div 2"
    parts = c.select("image_id", F.expr(f"stack(2, {place}, Y_, 16 + {place}, D_) as (p, v)")).unionByName(c.filter("y % 2 = 0 and x % 2 = 0").select("image_id", F.expr(f"stack(2, {small}, C_, {small} + 2, k_) as (p, v)")))
    return parts.select("image_id", F.col("p").cast("int").alias("p"), "v")


_f = ", ".join(f"{v} AS {k}" for k, v in tq._forward(Duck).items())
register("pck11_differences_420", differences_420, f"WITH {tq._cell}, f AS (SELECT *, {_f} FROM cell) SELECT image_id, CAST(4 * y + x AS INT) AS p, Y_ AS v FROM f UNION ALL SELECT image_id, CAST(16 + 4 * y + x AS INT), D_ FROM f UNION ALL SELECT image_id, CAST(32 + (y // 2) * 4 + x // 2 AS INT), C_ FROM f WHERE y % 2 = 0 AND x % 2 = 0 UNION ALL SELECT image_id, CAST(34 + (y // 2) * 4 + x // 2 AS INT), k_ FROM f WHERE y % 2 = 0 AND x % 2 = 0", "plane")


def repacked(s, d) -> DataFrame:
    """Quarter planes put back into a mosaic."""
    body = "case ({y} % 2) * 2 + {x} % 2 " + " ".join(f"when {k} then get({c}, cast(({{y}} div 2) * 4 + {{x}} div 2 as int))" for k, c in enumerate(("R0", "G0", "g1", "B0"))) + " end"
    return planes.samples(mosaic_planes(s, d).select("image_id", F.expr(planes.grid(8, 8, body)).alias("v")))


register("pck16_planes_to_mosaic", repacked, "SELECT image_id, y, x, v FROM plane", "plane")
register("pck17_interleave", lambda s, d: listed(planes.with_neighbours(planes.planes(s, d).drop("label"), 2).select("image_id", F.flatten(F.transform(F.arrays_zip("v", "v1", "v2"), lambda z: F.array(z["v"], z["v1"], z["v2"]))).alias("b")), "b"), "SELECT image_id, CAST(3 * (8 * y + x) + k AS INT) AS p, CASE k WHEN 0 THEN r WHEN 1 THEN g ELSE b END AS v FROM rgb, (SELECT unnest([0, 1, 2]) AS k)", "rgb")
register("snk05_mosaic_bytes", lambda s, d: planes.planes(s, d).select("image_id", F.hex(y4m.pack_samples("v")).alias("h")), "SELECT image_id, string_agg(printf('%02X', v), '' ORDER BY y, x) AS h FROM plane GROUP BY image_id", "plane")
register("snk07_yuv420p10_bytes", lambda s, d: planes.subsample(planes.planes(s, d, 10).drop("label"), "420", out="u").select("image_id", F.hex(F.concat(y4m.pack_samples("v", 10), y4m.pack_samples("u", 10), y4m.pack_samples("u", 10))).alias("h")), "WITH c AS (SELECT image_id, y // 2 AS y, x // 2 AS x, CAST(sum(v) // 4 AS INT) AS v FROM plane10 GROUP BY ALL), u AS (SELECT image_id, string_agg(printf('%02X%02X', v & 255, v >> 8), '' ORDER BY y, x) AS u FROM c GROUP BY image_id) SELECT image_id, string_agg(printf('%02X%02X', v & 255, v >> 8), '' ORDER BY y, x) || any_value(u) || any_value(u) AS h FROM plane10 JOIN u USING (image_id) GROUP BY image_id", "plane10")
register("snk10_markers_as_text", lambda s, d: jpeg.markers(tq._jpegs(s, d)).select("path", "seq", F.format_string("marker: 0x%04x section: %s offset: 0x%08x length: 0x%04x", F.expr("marker_id + 65280"), "marker", "offset", "length").alias("line")), tq._segments + " SELECT doc_id::VARCHAR AS path, CAST(seq AS INT) AS seq, printf('marker: 0x%04x section: %s offset: 0x%08x length: 0x%04x', CAST(m + 65280 AS INT), name, CAST(place AS INT), CAST(len AS INT)) AS line FROM r")
register("snk11_block_header", lambda s, d: tq._geometry(s, d).select("l_orderkey", "l_linenumber", F.concat(F.concat_ws(" ", F.lit("ALPHA"), "h", "w", "space", F.lit("warhol"), F.lit("8")), F.lit("\n")).alias("line")), f"WITH {tq._geo_sql}SELECT l_orderkey, l_linenumber, 'ALPHA ' || h || ' ' || w || ' ' || space || ' warhol 8' || chr(10) AS line FROM g")


def alpha_files(s, d) -> DataFrame:
    p = planes.extremes(planes.planes(s, d)).select("image_id", "v")
    return blocks.encode_planes(p, "warhol", 8, 8, 4).select("image_id", F.octet_length("file").alias("n"))


register("alp05_file_size", alpha_files, """WITH t AS (SELECT image_id, y // 4 AS by_, x // 4 AS bx_, CASE WHEN max(v) = 0 OR min(v) = 255 THEN 2 ELSE 130 END AS bits FROM ext GROUP BY ALL)
    SELECT image_id, CAST(24 + (sum(bits) + 7) // 8 AS INT) AS n FROM t GROUP BY image_id""", "ext")

# ---- frames ----


def ranged(s, d) -> DataFrame:
    value, broken = ranges.rescale(Spark, "v", (16, 235), (0, 255))
    frames = tq._frames(s, d).select((F.col("path") * 4 + F.col("frame_no")).alias("image_id"), "luma")
    return planes.samples(frames, v="luma").select("image_id", "y", "x", F.expr(value).alias("v"), F.expr(broken).alias("broken"))


_v, _b = ranges.rescale(Duck, "v", (16, 235), (0, 255))
register("src09_frames_to_full_range", ranged, f"SELECT image_id, y, x, {_v} AS v, {_b} AS broken FROM plane", "plane")
register("cnv05_frames_to_10bit", lambda s, d: planes.samples(tq._frames(s, d).select((F.col("path") * 4 + F.col("frame_no")).alias("image_id"), F.expr("transform(luma, z -> z * 4)").alias("v"))), "SELECT image_id, y, x, v * 4 AS v FROM plane", "plane")
register("cnv04_raw_to_stream", lambda s, d: y4m.file_bytes(planes.planes(s, d).select(F.col("image_id").alias("path"), F.lit(0).alias("frame_no"), "v"), ["path"], 8, 8, "mono", ["v"], extension={"EXTCS": "bayer_rggb8"}).select("path", F.octet_length("content").alias("n"), F.hex(F.expr("substring(content, 1, 12)")).alias("head")), "SELECT vec_id AS path, length('YUV4MPEG2 W8 H8 F25:1 Ip A0:0 Cmono XEXTCS=bayer_rggb8') + 1 + 6 + 64 AS n, '595556344D50454732205738' AS head FROM embeddings")
register("flt15_roi_frame", lambda s, d: y4m.file_bytes(pixels.crop(long_plane()(s, d), 2, 2, 6, 6).groupBy("image_id").agg(F.expr("transform(array_sort(collect_list(struct(y, x, v))), z -> z.v)").alias("v")).withColumn("frame_no", F.lit(0)), ["image_id"], 4, 4, "mono", ["v"]).select("image_id", F.hex(F.expr("substring(content, octet_length(content) - 15, 16)")).alias("h")), "SELECT image_id, string_agg(printf('%02X', v), '' ORDER BY y, x) AS h FROM plane WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 GROUP BY image_id", "plane")
register("src21_mosaic_in_stream", lambda s, d: planes.samples(y4m.planes(y4m.frames(y4m.file_bytes(planes.planes(s, d).select(F.col("image_id").alias("path"), F.lit(0).alias("frame_no"), "v"), ["path"], 8, 8, "mono", ["v"], extension={"EXTCS": "bayer_rggb8"}))).filter(F.col("extension")["EXTCS"] == "bayer_rggb8").select(F.col("path").alias("image_id"), "luma"), v="luma").select("image_id", F.expr("cast(y div 2 as int)").alias("y"), F.expr("cast(x div 2 as int)").alias("x"), F.expr("substr('RGgB', (y % 2) * 2 + x % 2 + 1, 1)").alias("plane"), "v"), "SELECT image_id, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, substr('RGgB', CAST((y % 2) * 2 + x % 2 + 1 AS INT), 1) AS plane, v FROM plane", "plane")

# ---- joins by place ----


def shifted(s, d) -> DataFrame:
    p = long_plane()(s, d)
    other = p.select("image_id", (F.col("y") + 1).alias("y"), (F.col("x") + 2).alias("x"), F.col("v").alias("w"))
    return p.join(other, PIXEL, "left").select(*PIXEL, "v", "w")


register("joi05_shifted", shifted, "SELECT image_id, y, x, l[y * 8 + x + 1] AS v, CASE WHEN y >= 1 AND x >= 2 THEN l[(y - 1) * 8 + x - 2 + 1] END AS w FROM spot", "spot")


def every_offset(s, d) -> DataFrame:
    """The sum of the 2 x 2 window at each place, from one summed-area table an image."""
    sums = planes.by_kernel(planes.planes(s, d).drop("label"), "v", planes.SIDE, planes.SIDE, lambda v: {"t": kernels.window_sums(v, 2, 2)}, {"t": "t"})
    return planes.samples(sums.drop("v"), planes.SIDE - 1, total="t").select("image_id", F.col("y").alias("oy"), F.col("x").alias("ox"), F.col("total").cast("long").alias("total"))


register("joi06_every_offset", every_offset, "SELECT p.image_id, CAST(oy AS INT) AS oy, CAST(ox AS INT) AS ox, CAST(sum(v) AS BIGINT) AS total FROM (SELECT unnest(range(7)) AS oy) CROSS JOIN (SELECT unnest(range(7)) AS ox) JOIN plane p ON p.y BETWEEN oy AND oy + 1 AND p.x BETWEEN ox AND ox + 1 GROUP BY ALL", "plane")


def neighbourhood(s, d) -> DataFrame:
    p = long_plane()(s, d)
    offsets = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    around = p.withColumn("o", F.explode(offsets)).select("image_id", "y", "x", (F.col("y") + F.col("o.dy")).alias("ny"), (F.col("x") + F.col("o.dx")).alias("nx"))
    return around.join(p.select("image_id", F.col("y").alias("ny"), F.col("x").alias("nx"), "v"), ["image_id", "ny", "nx"]).groupBy(*PIXEL).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


register("joi07_neighbourhood", neighbourhood, "SELECT p.image_id, p.y, p.x, count(*) AS n, CAST(sum(q.v) AS BIGINT) AS total FROM plane p JOIN plane q ON q.image_id = p.image_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 AND NOT (q.y = p.y AND q.x = p.x) GROUP BY ALL", "plane")


def halved(s, d) -> DataFrame:
    p = long_plane()(s, d)
    small = p.groupBy("image_id", F.expr("y div 2").alias("cy"), F.expr("x div 2").alias("cx")).agg(F.max("v").alias("top"))
    return p.withColumns({"cy": F.expr("y div 2"), "cx": F.expr("x div 2")}).join(small, ["image_id", "cy", "cx"]).select(*PIXEL, "v", "top")


register("joi08_one_to_four", halved, "SELECT image_id, y, x, v, max(v) OVER (PARTITION BY image_id, y // 2, x // 2) AS top FROM plane", "plane")


def matched_planes(s, d) -> DataFrame:
    """PSNR of planes by letter; an image whose letters differ from the other's is flagged."""
    p = planes.pairs(s, d).withColumn("plane", F.expr("substr('RGgB', (y % 2) * 2 + x % 2 + 1, 1)"))
    left, right = p.select(*PIXEL, "plane", "a"), p.filter("image_id % 5 <> 0 or plane <> 'B'").select(*PIXEL, "plane", "b")
    keys = left.groupBy("image_id").agg(F.array_sort(F.collect_set("plane")).alias("k")).join(right.groupBy("image_id").agg(F.array_sort(F.collect_set("plane")).alias("q")), "image_id").select("image_id", F.expr("k = q").alias("same_planes"))
    return metrics.psnr(left.join(right, [*PIXEL, "plane"]), ["image_id", "plane"]).join(keys, "image_id")


register("joi03_matched_planes", matched_planes, "WITH l AS (SELECT image_id, substr('RGgB', CAST((y % 2) * 2 + x % 2 + 1 AS INT), 1) AS plane, a, b FROM pair) SELECT image_id, plane, round(avg((a - b) * (a - b)), 6) AS mse, round(10 * log10(65025::DOUBLE / avg((a - b) * (a - b))), 6) AS psnr, image_id % 5 <> 0 AS same_planes FROM l WHERE image_id % 5 <> 0 OR plane <> 'B' GROUP BY image_id, plane", "pair")
register("pck20_mosaic_to_rgb_and_back", lambda s, d: demosaiced(s, d).select(*PIXEL, planes.remosaic("RGgB").alias("v")), "SELECT image_id, y, x, v FROM plane", "plane")

# ---- texts ----

_csv = "concat('qp_avg,qp_stddev,qp_num,qp_min,qp_max\\n', p_size, ',1.5,', p_partkey, ',3,9\\n0,0,0,0,0')"
register("str16_first_row", lambda s, d: tq._read(s, d, "part").select("p_partkey", F.from_csv(F.get(F.split(F.expr(_csv), "\n"), F.lit(1)), ", ".join(f"{f} double" for f in texts.QP_FIELDS)).alias("r")).select("p_partkey", "r.qp_avg", "r.qp_num", "r.qp_max"), "SELECT p_partkey, p_size::DOUBLE AS qp_avg, p_partkey::DOUBLE AS qp_num, 9.0::DOUBLE AS qp_max FROM part")


def metadata_json(s, d) -> DataFrame:
    """Grouped JSON metadata to prefixed, reduced keys."""
    text = F.concat(F.lit('[{"EXIF": {"Model": "'), "p_brand", F.lit('", "ThumbnailLength": "3"}, "ICC_Profile": {"RedTRC": "t", "ProfileID": "9"}, "File": {"x": "y"}}]'))
    parsed = F.from_json(text, "array<struct<EXIF:map<string,string>,ICC_Profile:map<string,string>>>")
    one = F.get(parsed, F.lit(0))
    merged = F.map_concat(texts.prefixed(one["EXIF"], "exif:"), texts.prefixed(one["ICC_Profile"], "icc:"))
    return tq._read(s, d, "part").select("p_partkey", F.explode(texts.reduced_metadata(merged)).alias("k", "v"))


register("str17_metadata_json", metadata_json, "SELECT p_partkey, 'exif:Model' AS k, p_brand AS v FROM part UNION ALL SELECT p_partkey, 'icc:red_trc', 't' FROM part")
register("str19_mix_definition", lambda s, d: tq._read(s, d, "part").select("p_partkey", F.expr("case p_size % 3 when 0 then 'y1u2v2' when 1 then 'y2v1u1' else 'y3u1v1' end").alias("m")).select("p_partkey", F.col("m").rlike("^([yuv][12]){3}$").alias("valid"), F.substring("m", 1, 2).alias("a"), F.substring("m", 3, 2).alias("b"), F.substring("m", 5, 2).alias("c")), "WITH m AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'y1u2v2' WHEN 1 THEN 'y2v1u1' ELSE 'y3u1v1' END AS m FROM part) SELECT p_partkey, regexp_matches(m, '^([yuv][12]){3}$') AS valid, substr(m, 1, 2) AS a, substr(m, 3, 2) AS b, substr(m, 5, 2) AS c FROM m")


def matrices(s, d) -> DataFrame:
    """The inverse of each matrix times pixels, taken as luma and chroma from 0 to 1."""
    px = planes.triples(s, d).select(*PIXEL, *[F.expr(f"{c} / 255D").alias(k) for c, k in zip("rgb", "luv", strict=True)])
    out = None
    for mc in (1, 5, 9):
        back = np.linalg.inv(colour.transfer_matrix(mc))[:3]
        rows = px.select(F.lit(mc).alias("mc"), *PIXEL, *[F.round(F.expr(e), 6).alias(c) for c, e in zip("rgb", colour.affine(Spark, back, list("luv")), strict=True)])
        out = rows if out is None else out.unionByName(rows)
    return out


register(
    "mth02_matrix_inverse", matrices,
    """WITH k(mc, kr, kb) AS (VALUES (1, 0.2126::DOUBLE, 0.0722::DOUBLE), (5, 0.299::DOUBLE, 0.114::DOUBLE), (9, 0.2627::DOUBLE, 0.0593::DOUBLE)),
    p AS (SELECT mc, kr, kb, image_id, y, x, r / 255.0::DOUBLE AS l, l + 2 * (1 - kr) * (b / 255.0::DOUBLE - 0.5) AS red, l + 2 * (1 - kb) * (g / 255.0::DOUBLE - 0.5) AS blue FROM rgb, k)
    SELECT mc, image_id, y, x, round(red, 6) AS r, round((l - kr * red - kb * blue) / (1 - kr - kb), 6) AS g, round(blue, 6) AS b FROM p""", "rgb",
)
register(
    "exp13_relabelled", lambda s, d: planes.samples(planes.mosaic_planes(planes.planes(s, d).drop("label"), "BGgR").select("image_id", F.col("R0").alias("first"), F.col("B0").alias("last")), 4, r="first", b="last"),
    "SELECT image_id, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, l[y * 8 + x + 1] AS r, l[(y - 1) * 8 + x - 1 + 1] AS b FROM spot WHERE y % 2 = 1 AND x % 2 = 1", "spot",
)
register("exp01_computed_columns", lambda s, d: tq.experiments(s, d).select("infile", "codec", "quality", F.round(results.bits_per_pixel("encoded_size", "64", "48"), 9).alias("bpp")), f"WITH {tq._exp}SELECT infile, codec, quality, round(8 * encoded_size / (64 * 48), 9) AS bpp FROM e")


# ---- wrappers and segments ----


def inner(s, d) -> DataFrame:
    return planes.samples(planes.demosaic_inner(planes.planes(s, d).drop("label"), "RGgB").drop("v"), r="r", g="g", b="b")


def _inner_sql() -> str:
    """Sums of the eight neighbours of the nearest place that has them all."""
    around, parts = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx], []
    for c in "rgb":
        of = "(" + ", ".join(str(k) for k, o in enumerate("RGgB") if o.lower() == c) + ")"
        hit = lambda dy, dx, of=of: f"((yy + {dy}) % 2) * 2 + (xx + {dx}) % 2 IN {of}"
        total = " + ".join(f"CASE WHEN {hit(*p)} THEN l[(yy + {p[0]}) * 8 + xx + {p[1]} + 1] ELSE 0 END" for p in around)
        n = " + ".join(f"CASE WHEN {hit(*p)} THEN 1 ELSE 0 END" for p in around)
        parts.append(f"CAST(CASE WHEN {hit(0, 0)} THEN l[yy * 8 + xx + 1] ELSE ({total} + ({n}) // 2) // greatest(1, {n}) END AS INT) AS {c}")
    return f"SELECT image_id, y, x, {', '.join(parts)} FROM (SELECT *, least(6, greatest(1, y)) AS yy, least(6, greatest(1, x)) AS xx FROM spot)"


register("dem05_inner_border", inner, _inner_sql(), "spot")


def packed_matrix(s, d) -> DataFrame:
    from ..sources import raw

    buffers = planes.planes(s, d).select("image_id", y4m.pack_samples("v").alias("content"))
    return planes.samples(raw.mosaic_samples(buffers, "content", "bayer_rggb8").select("image_id", F.col("samples").alias("v")))


register("pck13_packed_matrix", packed_matrix, "SELECT image_id, y, x, v FROM plane", "plane")
_ranged = {c: ranges.rescale(Duck, c, (16, 235) if c == "r" else (16, 240), (0, 255))[0] for c in "rgb"}
register("rng02_interleaved", lambda s, d: planes.triples(s, d).select(*PIXEL, *[F.expr(ranges.rescale(Spark, c, (16, 235) if c == "r" else (16, 240), (0, 255))[0]).alias(c) for c in "rgb"]), "SELECT image_id, y, x, " + ", ".join(f"{e} AS {c}" for c, e in _ranged.items()) + " FROM rgb", "rgb")


def subsampled_chroma(s, d) -> DataFrame:
    p = planes.with_neighbours(planes.planes(s, d).drop("label"), 2)
    for c in ("v1", "v2"):
        p = planes.subsample(p, "420", column=c, out=c)
    return planes.samples(p.drop("v"), 4, u="v1", w="v2")


register("sub04_yuv420", subsampled_chroma, "SELECT image_id, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, CAST(sum(g) // 4 AS INT) AS u, CAST(sum(b) // 4 AS INT) AS w FROM rgb GROUP BY image_id, y // 2, x // 2", "rgb")
register("str22_item_listing", lambda s, d: texts.container_items(tq._listing(s, d), "t", ["o_orderkey"]).groupBy("type").agg(F.count(F.lit(1)).alias("n")), "SELECT type, count(*) AS n FROM orders, (VALUES ('hvc1'), ('Exif')) t(type) GROUP BY type")


def colorimetry(s, d) -> DataFrame:
    """Settings of a trace, of an SPS and of a colour box in one map."""
    part = dealt(tq._read(s, d, "part").select("p_partkey", "p_size"), "p_partkey").withColumn("_x", F.expr("concat('<a><ColourInformationBox colour_type=\"nclx\" full_range_flag=\"', p_size % 2, '\"/></a>')"))
    text = lambda m: F.transform_values(m, lambda k, v: v.cast("string"))
    m = F.map_concat(text(texts.settings(F.expr("concat('colour_primaries = ', p_size)"), texts.COLOUR_KEYS, "hevc:")), text(texts.settings(F.expr("concat('general_level_idc: ', p_size + 1)"), texts.SPS_KEYS, "hvcC:", ":")), texts.colour_box(F.col("_x")))
    # explode would have its filter, and so all parsing, pushed below the deal as well
    return part.select("p_partkey", m.alias("m")).select("p_partkey", F.explode_outer("m").alias("k", "v")).filter("k is not null")


register("meta10_colorimetry", colorimetry, "SELECT p_partkey, k, CASE k WHEN 'hevc:cp' THEN p_size::VARCHAR WHEN 'hvcC:level' THEN (p_size + 1)::VARCHAR WHEN 'colr:fr' THEN (p_size % 2)::VARCHAR ELSE 'nclx' END AS v FROM part, (VALUES ('hevc:cp'), ('hvcC:level'), ('colr:fr'), ('colr:colour_type')) t(k)")

#: A segment of each kind whose fields follow from a document's number k: its marker, its bytes, and what is read from it, in SQL over k.
_b = lambda n: f"' || ({n}) || '"
_list = lambda e, n: f"' || array_to_string(list_transform(range({n}), lambda i: ({e})), ', ') || '"
_two = lambda v: int(v).to_bytes(2, "big")
SEGMENTS = {
    "jpg03_app0": (0xE0, lambda k: b"JFIF\0" + bytes([1, k % 3, k % 2]) + _two(k % 600) + _two(72) + bytes([k % 5, 0]), '{"type": "JFIF", "version_major": 1, "version_minor": ' + _b("k % 3") + ', "density_units": ' + _b("k % 2") + ', "xdensity": ' + _b("k % 600") + ', "ydensity": 72, "xthumbnail": ' + _b("k % 5") + ', "ythumbnail": 0}'),
    "jpg04_app1": (0xE1, lambda k: [b"Exif\0\0II", b"Exif\0\xffMM", b"other"][k % 3], '{"type": "' + _b("CASE WHEN k % 3 < 2 THEN 'EXIF' ELSE 'unknown' END") + '"}'),
    "jpg04_xmp": (0xE1, lambda k: (b"http://ns.adobe.com/xap/1.0/\0" if k % 2 else b"http://ns.adobe.com/xmp/extension/\0") + b"x" * (k % 40), '{"type": "' + _b("CASE WHEN k % 2 = 1 THEN 'Adobe XMP' ELSE 'Adobe extended XMP' END") + '"}'),
    "jpg05_app2": (0xE2, lambda k: b"ICC_PROFILE\0" + bytes([1 + k % 3, 3]) + b"p" * (k % 9), '{"type": "ICC_PROFILE", "chunk": ' + _b("1 + k % 3") + ', "chunks": 3}'),
    "jpg05_mpf": (0xE2, lambda k: b"MPF\0II" if k % 4 else b"FPXR\0", '{"type": "' + _b("CASE WHEN k % 4 <> 0 THEN 'MPF' ELSE 'unknown' END") + '"}'),
    "jpg06_app14": (0xEE, lambda k: b"Adobe\0" + bytes([k % 200, k % 7, 0, k % 4]), '{"version": ' + _b("k % 200") + ', "flags0": ' + _b("k % 7") + ', "flags1": 0, "transform": "' + _b("['Unknown (RGB or CMYK)', 'YCbCr', 'YCCK', 'unknown'][1 + k % 4]") + '"}'),
    "jpg07_comment": (0xFE, lambda k: f"made here by number {k}".encode() + b"\xc3", '{"comment": "made here by number ' + _b("k") + '"}'),
    "jpg08_quantisation": (0xDB, lambda k: bytes([k % 4]) + bytes(i * (k % 4) for i in range(64)) if k % 2 else bytes([0x10 | k % 4]) + b"".join(_two(i * (k % 11) + 1000) for i in range(64)), '{"tables": [{"Pq": ' + _b("(k + 1) % 2") + ', "Tq": ' + _b("k % 4") + ', "Q": [' + _list("i * (CASE WHEN k % 2 = 1 THEN k % 4 ELSE k % 11 END) + ((k + 1) % 2) * 1000", 64) + "]}]}"),
    "jpg09_restart": (0xDD, lambda k: _two(k % 65536), '{"interval": ' + _b("k % 65536") + "}"),
    "jpg10_scan": (0xDA, lambda k: bytes([1, 1 + k % 6, (k % 2) << 4 | k % 3, 0, 63, (k % 4) << 4 | k % 5]), '{"components": [{"component_id": ' + _b("1 + k % 6") + ', "component": "' + _b("['Y', 'Cb', 'Cr', 'I', 'Q', 'Unknown(6)'][1 + k % 6]") + '", "dc": ' + _b("k % 2") + ', "ac": ' + _b("k % 3") + '}], "spectral_selection": [0, 63], "approximation": [' + _b("k % 4") + ", " + _b("k % 5") + "]}"),
    "jpg11_frame": (0xC2, lambda k: bytes([8]) + _two(k % 4000) + _two(1 + k % 7000) + bytes([1, 1, (1 + k % 4) << 4 | 1 + k % 2, k % 3]), '{"sof": 2, "sample_precision": 8, "number_of_lines": ' + _b("k % 4000") + ', "number_of_samples_per_line": ' + _b("1 + k % 7000") + ', "components": [{"component_id": 1, "component": "Y", "horizontal": ' + _b("1 + k % 4") + ', "vertical": ' + _b("1 + k % 2") + ', "table": ' + _b("k % 3") + "}]}"),
    "jpg12_huffman": (0xC4, lambda k: bytes([(k % 2) << 4 | k % 3, 0, k % 4] + [0] * 14 + [j + k % 50 for j in range(k % 4)]), '{"tables": [{"Tc": ' + _b("k % 2") + ', "Th": ' + _b("k % 3") + ', "L": [0, ' + _b("k % 4") + ", 0" * 14 + '], "V": [[], [' + _list("i + k % 50", "k % 4") + "]" + ", []" * 14 + "]}]}"),
    "jpg13_ls_parameters": (0xF8, lambda k: bytes([1]) + b"".join(map(_two, (k % 4096, 3, 7, 21 + k % 9, 64))), '{"lse_id": 1, "type": "Preset coding parameters", "MAXVAL": ' + _b("k % 4096") + ', "T1": 3, "T2": 7, "T3": ' + _b("21 + k % 9") + ', "RESET": 64}'),
    "jpg13_ls_table": (0xF8, lambda k: bytes([2, k % 9, 1 + k % 3]) + b"e" * (6 * (k % 5)), '{"lse_id": 2, "type": "Mapping table specification", "table_id": ' + _b("k % 9") + ', "entry_width": ' + _b("1 + k % 3") + ', "num_entries": ' + _b("6 * (k % 5) // (1 + k % 3)") + "}"),
    "jpg14_app13": (0xED, lambda k: f"Photoshop {k % 9}.0".encode() + b"\0x", '{"text": "Photoshop ' + _b("k % 9") + '.0"}'), "jpg14_other": (0xE3, lambda k: b"z" * (k % 9), "{}"),
}


def segment_of(s, d, key: str) -> DataFrame:
    """A file for each document with the segment behind a comment of its own length, and what its marker says."""
    marker, data, _ = SEGMENTS[key]

    @F.pandas_udf(BinaryType())
    def files(ident: pd.Series) -> pd.Series:
        return pd.Series([jpeg.build([(0xE7, b"c" * (k % 30)), (marker, data(k))]) for k in ident.tolist()])

    docs = tq._read(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), files("doc_id").alias("content"))
    return jpeg.markers(docs).filter(f"marker_id = {marker}").select("path", "offset", "contents")


for _key, (_, _, _said) in SEGMENTS.items():
    register(_key, lambda s, d, k=_key: segment_of(s, d, k), f"SELECT doc_id::VARCHAR AS path, CAST(6 + k % 30 AS BIGINT) AS \"offset\", '{_said}' AS contents FROM (SELECT doc_id, doc_id AS k FROM documents)")
