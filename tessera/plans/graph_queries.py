"""Queries over the representation graph and the camera experiments; their SQL is written out step by step, without the kernels' formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import colour
from ..functions.sql import Duck
from ..operators import experiments, kernels, planes, representations, tiles
from ..sources import y4m
from ..sources.folders import dealt
from .image_queries import _near
from .registry import register

QUALITIES = (0, 50, 100)
_DROPPED = "(VALUES " + ", ".join(f"({q}, {7 - q * 7 // 100})" for q in QUALITIES) + ") k(quality, low)"


def mosaics(s, d) -> DataFrame:
    """image_id, content: the images as 8-bit mosaics."""
    return planes.planes(s, d).select("image_id", y4m.pack_samples("v").alias("content"))


def experiment(s, d, *approaches: str, averages: bool = False, places: int = 6) -> DataFrame:
    options = experiments.Options(codec="bits", qualities=QUALITIES, averages=averages)
    out = experiments.run(mosaics(s, d), "bayer_rggb8", planes.SIDE, planes.SIDE, list(approaches), options, name="image_id")
    figures = [c for c in out.columns if c.startswith("psnr")]
    return out.select("infile", "approach", F.col("quality").cast("int").alias("quality"), F.col("encoded_size").cast("double").alias("encoded_size"), "encoded_size_breakdown", F.col("encoded_bpp").cast("double").alias("encoded_bpp"), *[F.round(c, places).alias(c) for c in figures])


def _bits(e: str) -> str:
    return f"(({e}) >> low) << low"


def _coded(sizes: list[int]) -> tuple[str, str]:
    """Bytes and their breakdown, of planes of these many samples, in SQL."""
    each = [f"CAST(ceil({n} * (8 - low) / 8.0) AS BIGINT)" for n in sizes]
    return "(" + " + ".join(each) + ")", " || ':' || ".join(f"{e}::VARCHAR" for e in each)


_yuv = ", ".join(f"{e} AS {k}" for k, e in zip(("y_", "u_", "v_"), colour.rounded_yuv(Duck, ["r", "g", "b"]), strict=True))
_rgb = ", ".join(f"{e} AS {k}" for k, e in zip("rgb", colour.rounded_rgb(Duck, ["y_", "u_", "v_"]), strict=True))
_letter = "CASE (y % 2) * 2 + x % 2 WHEN 0 THEN r WHEN 3 THEN b ELSE g END"
#: rgb0 and yuv0 of the images; each experiment then says what comes back: m1 (image number with the quality), rgb1, yuv1.
_ORIGINAL = f"rgb0 AS MATERIALIZED ({_near('', {}, 'RGgB', 'plane')}), yuv0 AS MATERIALIZED (SELECT image_id, y, x, {_yuv} FROM rgb0)"
_FROM_MOSAIC = f"rgb1 AS MATERIALIZED ({_near('', {}, 'RGgB', 'm1')}), yuv1 AS (SELECT image_id, y, x, {_yuv} FROM rgb1)"
_MOSAIC = f"m1 AS MATERIALIZED (SELECT image_id * 1000 + quality AS image_id, y, x, CAST({_bits('v')} AS INT) AS v FROM plane, {_DROPPED}), {_FROM_MOSAIC}"
_FROM_YUV = f"rgb1 AS (SELECT image_id, y, x, {_rgb} FROM yuv1), m1 AS (SELECT image_id, y, x, {_letter} AS v FROM rgb1)"
#: Experiment: (samples of the planes coded, names of the tables).
STEPS = {
    "bayer-packed": ([64], _MOSAIC),
    "bayer-planar": ([16] * 4, _MOSAIC),
    "yuv444": ([64] * 3, f"yuv1 AS MATERIALIZED (SELECT image_id * 1000 + quality AS image_id, y, x, {', '.join(f'{_bits(c)} AS {c}' for c in ('y_', 'u_', 'v_'))} FROM yuv0, {_DROPPED}), {_FROM_YUV}"),
    "yuv420": ([64, 16, 16], f"""small AS MATERIALIZED (SELECT image_id, y // 2 AS sy, x // 2 AS sx, CAST(sum(u_) // 4 AS INT) AS u_, CAST(sum(v_) // 4 AS INT) AS v_ FROM yuv0 GROUP BY ALL),
        yuv1 AS MATERIALIZED (SELECT f.image_id * 1000 + quality AS image_id, f.y, f.x, {_bits('f.y_')} AS y_, {_bits('s.u_')} AS u_, {_bits('s.v_')} AS v_
            FROM yuv0 f JOIN small s ON s.image_id = f.image_id AND s.sy = f.y // 2 AND s.sx = f.x // 2, {_DROPPED}), {_FROM_YUV}"""),
    "rgb": ([64] * 3, f"rgb1 AS MATERIALIZED (SELECT image_id * 1000 + quality AS image_id, y, x, {', '.join(f'{_bits(c)} AS {c}' for c in 'rgb')} FROM rgb0, {_DROPPED}), yuv1 AS (SELECT image_id, y, x, {_yuv} FROM rgb1), m1 AS (SELECT image_id, y, x, {_letter} AS v FROM rgb1)"),
}


def _psnr(a: str, b: str) -> str:
    m = f"avg(({a} - {b}) * ({a} - {b}))"
    return f"10 * log10(65025::DOUBLE / CASE WHEN {m} = 0 THEN 1 / 64.0::DOUBLE ELSE {m} END)"


def experiment_sql(approach: str, places: int = 6) -> str:
    sizes, steps = STEPS[approach]
    total, parts = _coded(sizes)
    pairs = {"bayer": ("o.v", "m.v"), "r": ("c.r", "d.r"), "g": ("c.g", "d.g"), "b": ("c.b", "d.b"), "y": ("e.y_", "f.y_"), "u": ("e.u_", "f.u_"), "w": ("e.v_", "f.v_")}
    return f"""WITH {_ORIGINAL}, {steps},
    p AS (SELECT m.image_id // 1000 AS id, m.image_id % 1000 AS quality, {', '.join(f'{_psnr(*v)} AS {k}' for k, v in pairs.items())}
        FROM m1 m JOIN rgb1 d USING (image_id, y, x) JOIN yuv1 f USING (image_id, y, x)
        JOIN plane o ON o.image_id = m.image_id // 1000 AND o.y = y AND o.x = x JOIN rgb0 c ON c.image_id = o.image_id AND c.y = o.y AND c.x = o.x JOIN yuv0 e ON e.image_id = o.image_id AND e.y = o.y AND e.x = o.x
        GROUP BY m.image_id)
    SELECT id::VARCHAR AS infile, '{approach}' AS approach, CAST(p.quality AS INT) AS quality, {total}::DOUBLE AS encoded_size, {parts} AS encoded_size_breakdown, 8.0::DOUBLE * {total} / 64 AS encoded_bpp,
        round(bayer, {places}) AS psnr_bayer, round((r + g + b) / 3, {places}) AS psnr_rgb, round(r, {places}) AS psnr_rgb_r, round(g, {places}) AS psnr_rgb_g, round(b, {places}) AS psnr_rgb_b,
        round((y + u + w) / 3, {places}) AS psnr_yuv, round(y, {places}) AS psnr_yuv_y, round(u, {places}) AS psnr_yuv_u, round(w, {places}) AS psnr_yuv_v
    FROM p JOIN {_DROPPED} ON k.quality = p.quality"""


for _name, _approach in (("exp06_packed_sizes", "bayer-packed"), ("exp07_planar_sizes", "bayer-planar"), ("exp08_yuv444_sizes", "yuv444"), ("exp09_yuv420_sizes", "yuv420"), ("exp10_rgb_sizes", "rgb")):
    register(_name, lambda s, d, a=_approach: experiment(s, d, a), experiment_sql(_approach), "plane")


def sweep(s, d) -> DataFrame:
    """The averages of the sweep over five experiments."""
    out = experiment(s, d, *STEPS, averages=True, places=12).filter("infile = 'average'")
    figures = [c for c in out.columns if c.startswith(("psnr", "encoded_size", "encoded_bpp")) and c != "encoded_size_breakdown"]
    return out.select("infile", "approach", "quality", "encoded_size_breakdown", *[F.round(c, 6).alias(c) for c in figures])


def _sweep_sql() -> str:
    every = " UNION ALL ".join(f"SELECT * FROM ({experiment_sql(a, 12)})" for a in STEPS)
    figures = ["encoded_size", "encoded_bpp", "psnr_bayer", "psnr_rgb", "psnr_rgb_r", "psnr_rgb_g", "psnr_rgb_b", "psnr_yuv", "psnr_yuv_y", "psnr_yuv_u", "psnr_yuv_v"]
    return f"SELECT 'average' AS infile, approach, quality, '' AS encoded_size_breakdown, {', '.join(f'round(avg({c}), 6) AS {c}' for c in figures)} FROM ({every}) GROUP BY approach, quality"


register("exp14_mosaic_sweep", sweep, _sweep_sql(), "plane")

# ---- conversions between formats ----


def triple_bytes(s, d, chroma: int = 64) -> DataFrame:
    """image_id, content: three planes one behind the other, of the last two the first `chroma` samples."""
    three = planes.with_neighbours(planes.planes(s, d).drop("label"), 2)
    return three.select("image_id", y4m.pack_samples(f"concat(v, slice(v1, 1, {chroma}), slice(v2, 1, {chroma}))").alias("content"))


def graph(images: DataFrame, source: str, target: str) -> DataFrame:
    return representations.convert(images, source, target, planes.SIDE, planes.SIDE).select("image_id", F.hex("content").alias("h"))


register(
    "cnv01_rgb_to_packed_10", lambda s, d: graph(triple_bytes(s, d), "rgb8.planar", "pBAA"),
    """WITH m AS (SELECT image_id, y * 8 + x AS p, 4 * CASE (y % 2) * 2 + x % 2 WHEN 0 THEN b WHEN 3 THEN r ELSE g END AS v FROM rgb),
    g AS (SELECT image_id, p // 4 AS q, string_agg(printf('%02X', v >> 2), '' ORDER BY p) || printf('%02X', CAST(sum((v & 3) << CAST(2 * (p % 4) AS INT)) AS BIGINT)) AS h FROM m GROUP BY ALL)
    SELECT image_id, string_agg(h, '' ORDER BY q) AS h FROM g GROUP BY image_id""", "rgb",
)
register(
    "cnv01_mosaic_order_and_depth", lambda s, d: graph(mosaics(s, d), "bayer_bggr8", "RG10"),
    """WITH m AS (SELECT image_id, (y // 2) * 2 + CASE WHEN y % 2 = x % 2 THEN 1 - y % 2 ELSE y % 2 END AS y, (x // 2) * 2 + CASE WHEN y % 2 = x % 2 THEN 1 - x % 2 ELSE x % 2 END AS x, 4 * v AS v FROM plane)
    SELECT image_id, string_agg(printf('%02X%02X', v & 255, v >> 8), '' ORDER BY y, x) AS h FROM m GROUP BY image_id""", "plane",
)
register(
    "cnv01_yuv422_to_differences", lambda s, d: graph(triple_bytes(s, d, 32), "yuv422p8", "ydgcocg8.planar"),
    f"""WITH l AS (SELECT image_id, y, x, r AS y_, first.g AS u_, first.b AS v_ FROM rgb o JOIN LATERAL (SELECT g, b FROM rgb n WHERE n.image_id = o.image_id AND n.y * 8 + n.x = o.y * 4 + o.x // 2) first ON true),
    c AS (SELECT image_id, y, x, {_rgb} FROM l), m AS (SELECT image_id, y // 2 AS cy, x // 2 AS cx, max(r) FILTER (y % 2 = 0 AND x % 2 = 0) AS r0, max(g) FILTER (y % 2 = 0 AND x % 2 = 1) AS g0,
        max(g) FILTER (y % 2 = 1 AND x % 2 = 0) AS g1, max(b) FILTER (y % 2 = 1 AND x % 2 = 1) AS b0 FROM c GROUP BY ALL),
    f AS (SELECT image_id, cy * 4 + cx AS p, [(r0 >> 2) + (g0 >> 2) + (g1 >> 2) + (b0 >> 2), ((g1 - g0) >> 1) + 128, ((r0 - b0) >> 1) + 128, (((g0 >> 1) + (g1 >> 1) - (r0 >> 1) - (b0 >> 1)) >> 1) + 128] AS v FROM m)
    SELECT image_id, string_agg(printf('%02X', v[k]), '' ORDER BY k, p) AS h FROM f, (SELECT unnest([1, 2, 3, 4]) AS k) GROUP BY image_id""", "rgb",
)


def getters(s, d) -> DataFrame:
    """Every plane of every representation of a mosaic: letter, number of samples and their sum."""
    base, out = mosaics(s, d), None
    for fmt in ("bayer_rggb8.planar", "ydgcocg8.planar", "rgb8.planar", "yuv444p8"):
        there = representations.convert(base, "bayer_rggb8", fmt, planes.SIDE, planes.SIDE)
        rows = there.select("image_id", F.lit(fmt).alias("format"), F.explode(representations.plane_values(F.col("content"), fmt, planes.SIDE, planes.SIDE)).alias("plane", "v"))
        rows = rows.select("image_id", "format", "plane", F.size("v").alias("n"), F.expr("aggregate(v, 0L, (a, x) -> a + x)").alias("total"))
        out = rows if out is None else out.unionByName(rows)
    return out


register(
    "pck19_every_representation", getters,
    f"""WITH rgb0 AS MATERIALIZED ({_near('', {}, 'RGgB', 'plane')}), yuv0 AS (SELECT image_id, {_yuv} FROM rgb0),
    m AS (SELECT image_id, y // 2 AS cy, x // 2 AS cx, max(v) FILTER (y % 2 = 0 AND x % 2 = 0) AS r0, max(v) FILTER (y % 2 = 0 AND x % 2 = 1) AS g0, max(v) FILTER (y % 2 = 1 AND x % 2 = 0) AS g1, max(v) FILTER (y % 2 = 1 AND x % 2 = 1) AS b0 FROM plane GROUP BY ALL)
    SELECT image_id, 'bayer_rggb8.planar' AS format, k AS plane, 16 AS n, CAST(sum(CASE k WHEN 'R' THEN r0 WHEN 'G' THEN g0 WHEN 'g' THEN g1 ELSE b0 END) AS BIGINT) AS total FROM m, (SELECT unnest(['R', 'G', 'g', 'B']) AS k) GROUP BY image_id, k
    UNION ALL SELECT image_id, 'ydgcocg8.planar', k, 16, CAST(sum(CASE k WHEN 'Y' THEN (r0 >> 2) + (g0 >> 2) + (g1 >> 2) + (b0 >> 2) WHEN 'D' THEN ((g1 - g0) >> 1) + 128 WHEN 'C' THEN ((r0 - b0) >> 1) + 128
        ELSE (((g0 >> 1) + (g1 >> 1) - (r0 >> 1) - (b0 >> 1)) >> 1) + 128 END) AS BIGINT) FROM m, (SELECT unnest(['Y', 'D', 'C', 'c']) AS k) GROUP BY image_id, k
    UNION ALL SELECT image_id, 'rgb8.planar', k, 64, CAST(sum(CASE k WHEN 'r' THEN r WHEN 'g' THEN g ELSE b END) AS BIGINT) FROM rgb0, (SELECT unnest(['r', 'g', 'b']) AS k) GROUP BY image_id, k
    UNION ALL SELECT image_id, 'yuv444p8', k, 64, CAST(sum(CASE k WHEN 'y' THEN y_ WHEN 'u' THEN u_ ELSE v_ END) AS BIGINT) FROM yuv0, (SELECT unnest(['y', 'u', 'v']) AS k) GROUP BY image_id, k""", "plane",
)


# ---- tiles ----


def windowed_similarity(s, d) -> DataFrame:
    """Structural similarity by 5 x 5 Gaussian windows of each image and the next, over tiles of four rows and columns."""
    both = planes.with_neighbours(planes.planes(s, d).drop("label"), 1).select("image_id", y4m.pack_samples("v").alias("a"), y4m.pack_samples("v1").alias("b"))
    cut = tiles.cut(both, ["image_id"], ["a", "b"], planes.SIDE, planes.SIDE, size=4, before=0, after=4, edges=False)
    return tiles.similarity(cut, ["image_id"], "a", "b", size=5).select("image_id", F.round("ssim", 6).alias("ssim"))


_weights = ", ".join(f"({i}, {g!r}::DOUBLE)" for i, g in enumerate(kernels.gaussian(5).tolist()))
register(
    "agg15_windowed_similarity", windowed_similarity,
    f"""WITH g(i, w) AS (VALUES {_weights}), k AS (SELECT a.i AS dy, b.i AS dx, a.w * b.w AS w FROM g a, g b),
    m AS (SELECT image_id, y - dy AS oy, x - dx AS ox, sum(w * a) AS ma, sum(w * b) AS mb, sum(w * a * a) AS aa, sum(w * b * b) AS bb, sum(w * a * b) AS ab
        FROM pair, k WHERE y - dy BETWEEN 0 AND 3 AND x - dx BETWEEN 0 AND 3 GROUP BY ALL)
    SELECT image_id, round(avg(((2 * ma * mb + 6.5025) * (2 * (ab - ma * mb) + 58.5225)) / ((ma * ma + mb * mb + 6.5025) * (aa - ma * ma + bb - mb * mb + 58.5225))), 6) AS ssim FROM m GROUP BY image_id""", "pair",
)


def tiled_demosaic(s, d) -> DataFrame:
    """The mosaic of each image, demosaiced by tiles of 4 x 4 and put together again."""
    cut = tiles.cut(dealt(mosaics(s, d), "image_id"), ["image_id"], ["content"], planes.SIDE, planes.SIDE, size=4)
    whole = tiles.assemble(tiles.demosaic(cut, ["image_id"], "RGgB", plane="content"), ["image_id"], list("rgb"))
    return whole.select("image_id", *[F.hex(c).alias(c) for c in "rgb"])


_hex = ", ".join(f"string_agg(printf('%02X%02X', {c} & 255, {c} >> 8), '' ORDER BY y, x) AS {c}" for c in "rgb")
register("dem07_tiled_planes", tiled_demosaic, f"WITH rgb0 AS ({_near('', {}, 'RGgB', 'plane')}) SELECT image_id, {_hex} FROM rgb0 GROUP BY image_id", "plane")


def tiled_match(s, d) -> DataFrame:
    """One needle, a gradient of 3 x 3, in every image by tiles of four rows and columns."""
    import numpy as np

    cut = tiles.cut(mosaics(s, d), ["image_id"], ["content"], planes.SIDE, planes.SIDE, size=4, before=0, after=2, edges=False)
    return tiles.match(cut, ["image_id"], np.arange(9).reshape(3, 3) * 20, plane="content")


register(
    "flt09_tiled_match", tiled_match,
    """WITH t AS (SELECT k // 3 AS ty, k % 3 AS tx, 20 * k AS t FROM (SELECT unnest(range(9)) AS k)),
    m AS (SELECT image_id, y - ty AS oy, x - tx AS ox, sum(t) AS st, sum(v) AS si, sum(t * t) AS stt, sum(v * v) AS sii, sum(t * v) AS sti FROM plane, t WHERE y - ty BETWEEN 0 AND 5 AND x - tx BETWEEN 0 AND 5 GROUP BY ALL),
    c AS (SELECT image_id, oy, ox, CASE WHEN (9 * stt - st * st) * (9 * sii - si * si) <= 0 THEN 0.0::DOUBLE ELSE round((9 * sti - st * si)::DOUBLE / sqrt(((9 * stt - st * st) * (9 * sii - si * si))::DOUBLE), 9) END AS score FROM m)
    SELECT image_id, CAST(oy AS INT) AS y, CAST(ox AS INT) AS x, score FROM c QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, oy, ox) = 1""", "plane",
)
