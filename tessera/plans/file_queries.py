"""Queries through files: what the sinks write of the tables' images and results is read back by the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import colour
from ..functions.sql import Duck
from ..operators import metrics, planes, representations
from ..sources import images, raw, video
from ..sources.folders import dealt, scratch
from .graph_queries import mosaics, triple_bytes
from .image_queries import _near, long_plane
from .registry import register



def _base():
    """A path's last part."""
    return F.regexp_extract("path", r"([^/]*)$", 1)


def written_streams(s, d) -> str:
    """Every image is a frame of one of seven mono streams, in order of its number; the folder."""
    folder = scratch(s, "streams")
    rows = planes.planes(s, d).select(F.concat(F.lit("clip"), (F.col("image_id") % 7).cast("string")).alias("clip"), F.expr("image_id div 7").alias("frame_no"), "v")
    images.write_streams(rows, folder, "clip", planes.SIDE, planes.SIDE, "mono", ["v"], colorrange="limited", extension={"EXTCS": "bayer_rggb8"})
    return folder


def streams_back(s, d) -> DataFrame:
    got = video.read_video(s, written_streams(s, d), range_bytes=4096)
    return got.select(_base().alias("file"), "frame_no", "colorrange", F.col("extension")["EXTCS"].alias("pix_fmt"), F.hex("payload").alias("payload"))


register(
    "snk04_streams_written", streams_back,
    "SELECT 'clip' || image_id % 7 || '.y4m' AS file, image_id // 7 AS frame_no, 'LIMITED' AS colorrange, 'bayer_rggb8' AS pix_fmt, string_agg(printf('%02X', v), '' ORDER BY y, x) AS payload FROM plane GROUP BY image_id", "plane",
)


def whole_files(s, d) -> str:
    """Each document's text as a file, of a kind by its number, in one of 1,024 folders; the folder above them."""
    folder = scratch(s, "files")
    docs = dealt(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "doc_id")
    kind = F.expr("case doc_id % 3 when 0 then '.TXT' when 1 then '.jpg' else '' end")
    video.write_whole(docs.select(F.concat(F.lit("d"), "doc_id", kind).alias("name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")), folder, folders=1024)
    return folder


register(
    "src02_metadata", lambda s, d: raw.metadata(s, whole_files(s, d)).select(_base().alias("file"), "extension", "length"),
    "SELECT 'd' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.TXT' WHEN 1 THEN '.jpg' ELSE '' END AS file, CASE doc_id % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.jpg' ELSE '' END AS extension, octet_length(encode(coalesce(text, ''))) AS length FROM documents",
)
register(
    "src03_colour_range", lambda s, d: images.colour_range(s, whole_files(s, d)).select(_base().alias("file"), "range"),
    "SELECT 'd' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.TXT' WHEN 1 THEN '.jpg' ELSE '' END AS file, CASE doc_id % 3 WHEN 1 THEN 'full' ELSE 'unspecified' END AS range FROM documents",
)


def histogram_file(s, d) -> DataFrame:
    """The histogram of all samples through a CSV file with a header."""
    folder = scratch(s, "table")
    images.write_table(metrics.histogram(long_plane()(s, d)), folder)
    return s.read.option("header", True).schema("value int, hist long, ratio double").csv(folder)


register(
    "snk08_histogram_file", histogram_file,
    "WITH n AS (SELECT count(*) AS n FROM plane), c AS (SELECT v, count(*) AS hist FROM plane GROUP BY v) SELECT CAST(k AS INT) AS value, coalesce(hist, 0) AS hist, round(coalesce(hist, 0) / n::DOUBLE, 9) AS ratio FROM (SELECT unnest(range(256)) AS k) LEFT JOIN c ON c.v = k, n", "plane",
)


def converted_files(s, d) -> DataFrame:
    """Raw mosaic files of every image to 4:4:4 of 10 bits."""
    source, target = scratch(s, "raw"), scratch(s, "converted")
    video.write_whole(mosaics(s, d).withColumn("name", F.concat("image_id", F.lit(".raw"))), source)
    representations.convert_files(s, source, "bayer_rggb8", planes.SIDE, planes.SIDE, "yuv444p10", target)
    return s.read.format("binaryFile").load(target).select(F.regexp_extract("path", r"(\d+)\.raw$", 1).cast("long").alias("image_id"), F.hex("content").alias("h"))


_yuv10 = ", ".join(f"{e} AS {k}" for k, e in zip(("y_", "u_", "v_"), colour.rounded_yuv(Duck, ["r", "g", "b"], 10), strict=True))
register(
    "cnv03_files", converted_files,
    f"""WITH deep AS (SELECT image_id, y, x, v * 4 AS v FROM plane), c AS ({_near('', {}, 'RGgB', 'deep')}), f AS (SELECT image_id, y * 8 + x AS p, {_yuv10} FROM c),
    s AS (SELECT image_id, k, p, CASE k WHEN 0 THEN y_ WHEN 1 THEN u_ ELSE v_ END AS v FROM f, (SELECT unnest([0, 1, 2]) AS k))
    SELECT image_id, string_agg(printf('%02X%02X', v & 255, v >> 8), '' ORDER BY k, p) AS h FROM s GROUP BY image_id""", "plane",
)


def coloured_files(s, d) -> DataFrame:
    """Raw files of red, green and blue planes by a named conversion."""
    source, target = scratch(s, "rgb"), scratch(s, "coloured")
    video.write_whole(triple_bytes(s, d).withColumn("name", F.concat("image_id", F.lit(".rgb"))), source)
    images.convert_colour_files(s, source, planes.SIDE, planes.SIDE, target, "sdtv.computer")
    return s.read.format("binaryFile").load(target).select(F.regexp_extract("path", r"(\d+)\.rgb$", 1).cast("long").alias("image_id"), F.hex("content").alias("h"))


register(
    "col20_files", coloured_files,
    """WITH s AS (SELECT image_id, k, y * 8 + x AS p, CASE k WHEN 0 THEN 0.257::DOUBLE * r + 0.504::DOUBLE * g + 0.098::DOUBLE * b + 16
        WHEN 1 THEN -0.148::DOUBLE * r + -0.291::DOUBLE * g + 0.439::DOUBLE * b + 128 ELSE 0.439::DOUBLE * r + -0.368::DOUBLE * g + -0.071::DOUBLE * b + 128 END AS v FROM rgb, (SELECT unnest([0, 1, 2]) AS k))
    SELECT image_id, string_agg(printf('%02X', CAST(trunc(least(255, greatest(0, v))) AS INT)), '' ORDER BY k, p) AS h FROM s GROUP BY image_id""", "rgb",
)


def every_kind(s, d) -> DataFrame:
    """Streams, baseline files and foreign files of one folder in one schema: what each kind gives, with the sum of its samples."""
    from .metadata_queries import coded_images

    folder = written_streams(s, d)
    video.write_whole(coded_images(s, d).select(F.concat("image_id", F.expr("case when image_id % 5 = 0 then '.txt' else '.jpg' end")).alias("name"), F.col("content")), folder)
    got = images.read_planes(s, folder)
    total = F.expr("aggregate(planes['y'].v, 0L, (a, x) -> a + x)")
    return got.select(F.regexp_extract(_base(), r"(\.[^.]*)$", 1).alias("kind"), "status", F.when(F.col("status") == "ok", total).alias("total")).groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("total"))


register(
    "src01_every_kind", every_kind,
    """WITH t AS (SELECT image_id, sum(v) AS total FROM plane GROUP BY image_id)
    SELECT '.y4m' AS kind, 'ok' AS status, count(*) AS n, CAST(sum(total) AS BIGINT) AS total FROM t UNION ALL SELECT '.jpg', 'ok', count(*), CAST(64 * sum(total) AS BIGINT) FROM t WHERE image_id % 5 <> 0
    UNION ALL SELECT '.txt', 'no reader for .txt', count(*), NULL FROM t WHERE image_id % 5 = 0""", "plane",
)


def demosaic_by_name(s, d) -> DataFrame:
    """The way is chosen by name for each image."""
    base, out = planes.planes(s, d).drop("label"), None
    for k, name in enumerate(sorted(planes.DEMOSAIC)):
        one = planes.DEMOSAIC[name](base.filter(F.col("image_id") % len(planes.DEMOSAIC) == k), "RGgB").drop("v").withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return planes.samples(out, r="r", g="g", b="b")


register(
    "dem04_by_name", demosaic_by_name,
    f"""WITH p0 AS (SELECT * FROM plane WHERE image_id % 3 = 0), p1 AS (SELECT * FROM plane WHERE image_id % 3 = 1),
    a AS ({_near('', {}, 'RGgB', 'p0')}), b AS ({_near('', {}, 'RGgB', 'p1', True)}),
    i AS (SELECT image_id, y, x, l, least(6, greatest(1, y)) AS j, least(6, greatest(1, x)) AS k FROM spot WHERE image_id % 3 = 2),
    c AS (SELECT image_id, y, x, (j % 2) * 2 + k % 2 AS cell, l[j * 8 + k + 1] AS own, l[j * 8 + k] + l[j * 8 + k + 2] AS across, l[j * 8 + k - 7] + l[j * 8 + k + 9] AS along,
        l[j * 8 + k - 8] + l[j * 8 + k - 6] + l[j * 8 + k + 8] + l[j * 8 + k + 10] AS corners FROM i)
    SELECT image_id, 'bilinear' AS name, y, x, r, g, b FROM a UNION ALL SELECT image_id, 'gradient', y, x, r, g, b FROM b
    UNION ALL SELECT image_id, 'inner', y, x, CAST(CASE cell WHEN 0 THEN own WHEN 1 THEN (across + 1) // 2 WHEN 2 THEN (along + 1) // 2 ELSE (corners + 2) // 4 END AS INT) AS r,
        CAST(CASE WHEN cell IN (1, 2) THEN own ELSE (across + along + 2) // 4 END AS INT) AS g,
        CAST(CASE cell WHEN 3 THEN own WHEN 2 THEN (across + 1) // 2 WHEN 1 THEN (along + 1) // 2 ELSE (corners + 2) // 4 END AS INT) AS b FROM c""", "plane", "spot",
)
