"""Queries over parameter sets and colour profiles that are built from the tables' rows, and over JPEG segments whose fields follow from the documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..operators import planes
from ..sources import hevc, icc, jpeg, jpeg_pixels
from ..sources.folders import dealt
from .registry import register

# ---- parameter sets ----


@F.pandas_udf(BinaryType())
def _sps_box(key: pd.Series, size: pd.Series) -> pd.Series:
    """A box with a parameter set whose fields follow from a part's key and size; every fourth has no usability part."""
    out = []
    for k, n in zip(key.tolist(), size.tolist(), strict=True):
        colour = None if k % 4 == 0 else (k % 2, 1 + n % 9, 1 + k % 18, n % 15)
        nal = hevc.write_sps(16 * (n + 4), 8 * (1 + k % 200), 8 + 2 * (n % 2), 1 + n % 3, 30 * (1 + k % 6), 1 + k % 3, (k % 3, n % 2), 1 + k % 4, tuple([k % 3] * (n % 5)), colour)
        out.append(hevc.write_box([(32, [b"\x40\x01" + bytes(k % 5)]), (33, [nal])], 1 + n % 3, 30 * (1 + k % 6)))
    return pd.Series(out)


def boxes(s, d) -> DataFrame:
    part = dealt(s.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size"), "p_partkey")
    return part.select(F.col("p_partkey").cast("string").alias("path"), _sps_box("p_partkey", "p_size").alias("content"))


_SETS = ("w", "h", "depth_luma", "profile", "level", "chroma_format", "sub_layers", "reference_sets", "fr", "cp", "tc", "mc")
_sets_sql = """SELECT p_partkey::VARCHAR AS path, CAST(16 * (p_size + 4) - CASE WHEN p_partkey % 3 = 2 THEN 1 ELSE 2 END * (p_partkey % 3) AS INT) AS w,
    CAST(8 * (1 + p_partkey % 200) - CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END * (p_size % 2) AS INT) AS h, CAST(8 + 2 * (p_size % 2) AS INT) AS depth_luma, CAST(1 + p_size % 3 AS INT) AS profile,
    CAST(30 * (1 + p_partkey % 6) AS INT) AS level, CAST(1 + p_partkey % 3 AS INT) AS chroma_format, CAST(1 + p_partkey % 4 AS INT) AS sub_layers, CAST(p_size % 5 AS INT) AS reference_sets,
    CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey % 2 AS INT) END AS fr, CASE WHEN p_partkey % 4 <> 0 THEN CAST(1 + p_size % 9 AS INT) END AS cp,
    CASE WHEN p_partkey % 4 <> 0 THEN CAST(1 + p_partkey % 18 AS INT) END AS tc, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size % 15 AS INT) END AS mc FROM part"""
register("hev01_parameter_sets", lambda s, d: hevc.parameter_sets(hevc.nal_units(boxes(s, d))).select("path", *[F.col(f"sps.{c}").alias(c) for c in _SETS]), _sets_sql)
register(
    "meta10_colour_of_parameter_sets", lambda s, d: hevc.colorimetry(boxes(s, d)).select("path", F.explode("meta").alias("k", "v")),
    f"WITH f AS ({_sets_sql}) SELECT path, 'hvcC:' || k AS k, v FROM (UNPIVOT (SELECT path, profile, level, fr, cp, tc, mc FROM f) ON profile, level, fr, cp, tc, mc INTO NAME k VALUE v)",
)

# ---- profiles ----


def _profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """JPEG files whose profile holds a whole text and a curve by the document's number, in chunks, the last first. A few files at a time, as a batch of rows may hold many texts."""
    for b in batches:
        for at in range(0, len(b), 64):
            paths, files = [], []
            for k, t in zip(*(c.to_pylist() for c in b.slice(at, 64).columns), strict=True):
                profile = icc.build({"cprt": b"text" + bytes(4) + (t or "").encode(), "rTRC": icc.parametric(3, 1 + k % 16 / 16, 0.5, -k % 8 / 4, 0.125, 0), "gTRC": icc.sampled(*range(k % 4))}, (2 + k % 3, k % 10))
                paths.append(str(k))
                files.append(jpeg.build([(0xE0, b"JFIF\0\1\2\0\0\1\0\1\0\0"), *icc.to_chunks(profile)[::-1], (0xFE, b"end")]))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(files, pa.binary())], names=["path", "content"])


def profile_tags(s, d) -> DataFrame:
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").mapInArrow(_profiled, "path string, content binary")
    found = icc.profiles(docs)
    rows = icc.tags(found.withColumns({k: v for k, v in icc.header().items() if k == "profile_version"}))
    shown = F.when(F.col("tag") == "cprt", F.sha2(F.encode(icc.text_of("data"), "UTF-8"), 256)).otherwise(F.array_join(F.transform(icc.curve_values("data"), lambda v: v.cast("string")), " "))
    return rows.select("path", "status", "profile_version", "tag", shown.alias("value"))


register(
    "jpg05_profile_in_chunks", profile_tags,
    """WITH d AS (SELECT doc_id::VARCHAR AS path, 'ok' AS status, (2 + doc_id % 3) || '.' || (doc_id % 10) AS profile_version, doc_id AS k, text FROM documents)
    SELECT path, status, profile_version, 'cprt' AS tag, sha256(coalesce(text, '')) AS value FROM d
    UNION ALL SELECT path, status, profile_version, 'rTRC', (1 + (k % 16) / 16.0::DOUBLE)::VARCHAR || ' 0.5 ' || (((8 - k % 8) % 8) / 4.0::DOUBLE)::VARCHAR || ' 0.125 0.0' FROM d
    UNION ALL SELECT path, status, profile_version, 'gTRC', CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN '0.0' WHEN 2 THEN '0.0 1.0' ELSE '0.0 1.0 2.0' END FROM d""",
)


@F.pandas_udf(BinaryType())
def _curve(key: pd.Series) -> pd.Series:
    return pd.Series([icc.parametric(k % 5, *[(k + j) % 64 / 16 - 1 for j in range(icc.PARAMETERS[k % 5])]) for k in key.tolist()])


def curve_texts(s, d) -> DataFrame:
    part = s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat(F.lit("base64:"), F.base64(_curve("p_partkey"))).alias("c"), "p_brand")
    meta = part.withColumn("meta", F.create_map(F.lit("icc:red_trc"), F.col("c"), F.lit("icc:profile_class"), F.col("p_brand"), F.lit("icc:blue_trc"), F.lit("none")))
    return icc.decoded_curves(meta, "meta").select("p_partkey", F.col("meta")["icc:red_trc"].alias("red"), F.col("meta")["icc:profile_class"].alias("kind"), F.col("meta")["icc:blue_trc"].alias("blue"))


register(
    "str17_curve_values", curve_texts,
    """SELECT p_partkey, array_to_string(list_transform(range(CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 5 ELSE 7 END), lambda j: ((((p_partkey + j) % 64) / 16.0::DOUBLE) - 1)::VARCHAR), ' ') AS red,
    p_brand AS kind, 'none' AS blue FROM part""",
)


# ---- pixels of baseline files ----


@F.pandas_udf(BinaryType())
def _coded(v: pd.Series) -> pd.Series:
    return pd.Series([jpeg_pixels.encode([np.array(x).reshape(8, 8)], [(1, 1)], 8, 8, q=12) for x in v])


@F.pandas_udf(BinaryType())
def _flat(v: pd.Series) -> pd.Series:
    """Files in which each sample is a block of 8 x 8, which is coded without loss."""
    return pd.Series([jpeg_pixels.encode([np.kron(np.array(x).reshape(8, 8), np.ones((8, 8), int))], [(1, 1)], 64, 64) for x in v])


def coded_images(s, d) -> DataFrame:
    """image_id, content: the images, eight times as large, as baseline files without loss."""
    return planes.planes(s, d).select("image_id", _flat("v").alias("content"))


def decoded_pixels(s, d) -> DataFrame:
    """The images as baseline files, decoded again."""
    files = planes.planes(s, d).select("image_id", _coded("v").alias("content"))
    read = files.select("image_id", jpeg_pixels.decoded(F.col("content")).alias("d"))
    return planes.samples(read.select("image_id", "d.status", F.col("d.planes")["y"]["v"].alias("v")))


_cos = "(CASE WHEN {u} = 0 THEN sqrt(0.125::DOUBLE) ELSE 0.5::DOUBLE END * cos((2 * {x} + 1) * {u} * pi() / 16))"
register(
    "src24_baseline_pixels", decoded_pixels,
    f"""WITH n AS (SELECT unnest(range(8)) AS k), basis AS MATERIALIZED (SELECT a.k AS u, b.k AS x, {_cos.format(u='a.k', x='b.k')} AS c FROM n a, n b),
    c AS MATERIALIZED (SELECT image_id, f.u AS i, g.u AS j, floor(sum((v - 128) * f.c * g.c) / 12 + 0.5 + 1e-7) AS q FROM plane p JOIN basis f ON f.x = p.y JOIN basis g ON g.x = p.x GROUP BY ALL)
    SELECT image_id, 'ok' AS status, CAST(f.x AS INT) AS y, CAST(g.x AS INT) AS x, CAST(least(255, greatest(0, floor(sum(12 * q * f.c * g.c) + 0.5 + 1e-7) + 128)) AS INT) AS v
    FROM c JOIN basis f ON f.u = c.i JOIN basis g ON g.u = c.j GROUP BY image_id, f.x, g.x""", "plane",
)
