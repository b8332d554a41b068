"""Queries over images: colour, ranges, packing, mosaics, sampling, filters, metrics, block codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import colour, packing, ranges
from ..functions.sql import Duck, Spark
from ..operators import blocks, metrics, pixels, planes
from .registry import register

PIXEL = ("image_id", "y", "x")


def long_plane(depth: int = 8):
    return lambda s, d: planes.samples(planes.planes(s, d, depth).drop("label"))


def project(df: DataFrame, keys=PIXEL, **parts: str) -> DataFrame:
    return df.select(*keys, *[F.expr(v).alias(k) for k, v in parts.items()])


def pixel_query(name: str, relation: str, source, formula, relations: tuple[str, ...] = ()) -> None:
    """formula(dialect) gives name -> expression over the relation's columns; every pixel is a row of the result."""
    select = ", ".join(f"{v} AS {k}" for k, v in formula(Duck).items())
    register(name, lambda s, d: project(source(s, d), **formula(Spark)), f"SELECT image_id, y, x, {select} FROM {relation}", *(relations or (relation,)))


# ---- colour ----

CHECKED = ("r", "g", "b")
_rounded = lambda d, names, xs: {n: f"(round({x}, 6) + 0)" for n, x in zip(names, xs, strict=True)}


def _colour(key: str, name: str, **how) -> None:
    decimal = name in ("yiq", "hdtv.digital")

    def forward(d):
        xs = colour.convert_sql(d, name, "rgb2yuv", list(CHECKED))
        return _rounded(d, ("c0", "c1", "c2"), xs) if decimal else dict(zip(("c0", "c1", "c2"), xs, strict=True))

    pixel_query(f"{key}_forward", "rgb", planes.triples, forward)
    if name != "yiq":
        pixel_query(f"{key}_inverse", "rgb", planes.triples, lambda d: dict(zip(CHECKED, colour.convert_sql(d, name, "yuv2rgb", list(CHECKED)), strict=True)))
    else:
        pixel_query(f"{key}_inverse", "rgb", planes.triples, lambda d: _rounded(d, CHECKED, colour.convert_sql(d, name, "yuv2rgb", list(CHECKED))))


for _key, _name in {
    "col01_yiq": "yiq", "col02_sdtv_basic": "sdtv.basic", "col03_sdtv_analog": "sdtv.analog", "col04_sdtv_digital": "sdtv.digital", "col05_sdtv_computer": "sdtv.computer", "col06_hdtv_basic": "hdtv.basic",
    "col07_hdtv_analog": "hdtv.analog", "col08_hdtv_digital": "hdtv.digital", "col09_hdtv_computer": "hdtv.computer", "col10_ycocg": "ycocg", "col11_ycocgr": "ycocgr", "col17_unit": "unit",
}.items():
    _colour(_key, _name)

for _mc in colour.H273_NUMBERS:
    pixel_query(f"col12_h273_{_mc}", "rgb", planes.triples, lambda d, m=_mc: dict(zip(("c0", "c1", "c2"), colour.h273(d, list(CHECKED), m, True), strict=True)))
    pixel_query(f"col13_h273_inverse_{_mc}", "rgb", planes.triples, lambda d, m=_mc: dict(zip(CHECKED, colour.h273(d, list(CHECKED), m, False), strict=True)))
    if _mc != 14:
        pixel_query(f"col14_h273_transfer_{_mc}", "rgb", planes.triples, lambda d, m=_mc: dict(zip(("c0", "c1", "c2"), colour.h273_transfer(d, list(CHECKED), m, True), strict=True)))
        pixel_query(f"col15_h273_transfer_inverse_{_mc}", "rgb", planes.triples, lambda d, m=_mc: dict(zip(CHECKED, colour.h273_transfer(d, list(CHECKED), m, False), strict=True)))
pixel_query("col16_h273_limited", "rgb", planes.triples, lambda d: dict(zip(("c0", "c1", "c2"), colour.h273(d, list(CHECKED), 1, True, yuv_limited=True), strict=True)))
pixel_query("col21_bgr_to_ycrcb", "rgb", planes.triples, lambda d: dict(zip(("y_", "cb", "cr"), colour.rounded_yuv(d, list(CHECKED), 8, 0.713, 0.564), strict=True)))
pixel_query("col22_yuv", "rgb", planes.triples, lambda d: dict(zip(("y_", "u", "v"), colour.rounded_yuv(d, list(CHECKED)), strict=True)))
pixel_query("col22_yuv_10bit", "rgb10", lambda s, d: planes.triples(s, d, 10), lambda d: dict(zip(("y_", "u", "v"), colour.rounded_yuv(d, list(CHECKED), 10), strict=True)))
pixel_query("col22_rgb", "rgb", planes.triples, lambda d: dict(zip(CHECKED, colour.rounded_rgb(d, list(CHECKED)), strict=True)))
pixel_query("col26_rgb_as_yuv", "rgb", planes.triples, lambda d: dict(zip(("c0", "c1", "c2"), colour.rounded_rgb(d, ["g", "b", "r"]), strict=True)))

_cell = """SELECT image_id, y // 2 AS y, x // 2 AS x, max(v) FILTER (y % 2 = 0 AND x % 2 = 0) AS r0, max(v) FILTER (y % 2 = 0 AND x % 2 = 1) AS g0,
    max(v) FILTER (y % 2 = 1 AND x % 2 = 0) AS g1, max(v) FILTER (y % 2 = 1 AND x % 2 = 1) AS b0 FROM {} GROUP BY ALL"""


def cells(s, d, depth: int = 8) -> DataFrame:
    return planes.samples(planes.mosaic_planes(planes.planes(s, d, depth).drop("label"), "RGgB").drop("v"), 4, r0="R0", g0="G0", g1="g1", b0="B0")


def _diff(d, depth):
    return {f"{k.upper() if k != 'c' else 'k'}_": v for k, v in colour.mosaic_differences(d, "r0", "g0", "g1", "b0", depth).items()}


def _back(d, depth):
    return {f"{k.lower()}{int(k == 'g')}": v for k, v in colour.mosaic_from_differences(d, "r0", "g0", "g1", "b0", depth).items()}


for _depth, _rel in ((8, "plane"), (10, "plane10")):
    for _key, _formula in (("col23_mosaic_differences", _diff), ("col24_mosaic_from_differences", _back)):
        register(f"{_key}_{_depth}", lambda s, d, n=_depth, f=_formula: project(cells(s, d, n), **f(Spark, n)), f"WITH cell AS ({_cell.format(_rel)}) SELECT image_id, y, x, {', '.join(f'{v} AS {k}' for k, v in _formula(Duck, _depth).items())} FROM cell", _rel)
pixel_query("col25_stored_signed", "pair", planes.pairs, lambda d: {"stored": ranges.store_signed(d, "(a - b)", 8), "loaded": ranges.load_signed("a", 8)})


def whole_image(s, d):
    """A whole image by name and direction, then one pixel of it."""
    return colour.convert(planes.triples(s, d), "sdtv.computer", "rgb2yuv")


register("col18_convert_image", lambda s, d: whole_image(s, d).select(*PIXEL, "c0", "c1", "c2"), "SELECT image_id, y, x, " + ", ".join(f"{e} AS c{i}" for i, e in enumerate(colour.convert_sql(Duck, "sdtv.computer", "rgb2yuv", list(CHECKED)))) + " FROM rgb", "rgb")
register("col19_convert_pixel", lambda s, d: whole_image(s, d).filter("y = 3 and x = 5").select("image_id", "c0", "c1", "c2"), "SELECT image_id, " + ", ".join(f"{e} AS c{i}" for i, e in enumerate(colour.convert_sql(Duck, "sdtv.computer", "rgb2yuv", list(CHECKED)))) + " FROM rgb WHERE y = 3 AND x = 5", "rgb")

# ---- ranges ----


def _rescaled(d, kind, back, depth=8):
    lim, full = ranges.ends(depth, kind, True), ranges.ends(depth, kind, False)
    v, broken = ranges.rescale(d, "v", lim if back else full, full if back else lim)
    return {"v": v, "broken": broken}


for _kind in ("luma", "chroma"):
    pixel_query(f"rng03_{_kind}_to_limited", "plane", long_plane(), lambda d, k=_kind: _rescaled(d, k, False))
    pixel_query(f"rng04_{_kind}_to_full", "plane", long_plane(), lambda d, k=_kind: _rescaled(d, k, True))
    pixel_query(f"rng05_{_kind}_10bit", "plane10", long_plane(10), lambda d, k=_kind: _rescaled(d, k, True, 10))
    for _way, _back_ in (("fr2lr", False), ("lr2fr", True)):
        pixel_query(f"rng06_{_kind}_{_way}", "plane10", long_plane(10), lambda d, k=_kind, b=_back_: {"v": ranges.rescale_clipped(d, "v", ranges.ends(10, k, b), ranges.ends(10, k, not b), (0, 1023))})
for _top in (235, 240):
    pixel_query(f"rng07_full_to_limited_{_top}", "ext", lambda s, d: planes.samples(planes.extremes(planes.planes(s, d)).drop("label")), lambda d, t=_top: {"v": ranges.full_to_limited(d, "v", t)})
    pixel_query(f"rng07_limited_to_full_{_top}", "ext", lambda s, d: planes.samples(planes.extremes(planes.planes(s, d)).drop("label")), lambda d, t=_top: {"v": ranges.limited_to_full(d, "v", t)})
pixel_query("rng08_rgb_to_limited", "rgb", planes.triples, lambda d: {c: ranges.full_to_limited(d, c, 235) for c in CHECKED})
pixel_query("rng08_rgb_to_full", "rgb", planes.triples, lambda d: {c: ranges.limited_to_full(d, c, 235) for c in CHECKED})
pixel_query("rng09_clamp", "pair", planes.pairs, lambda d: {"v": "least(255, greatest(0, 2 * a - b))"})


def range_components(s, d):
    parts = {}
    for c, kind in zip(CHECKED, ("luma", "chroma", "chroma"), strict=True):
        parts[c], parts[c + "_broken"] = ranges.rescale(Spark, c, ranges.ends(8, kind, True), ranges.ends(8, kind, False))
    out = project(planes.triples(s, d), **parts)
    flags = [F.bool_or(c + "_broken").alias(c + "_broken") for c in CHECKED]
    return out.groupBy("image_id").agg(*flags, F.bool_or(F.expr("r_broken or g_broken or b_broken")).alias("broken"), F.sum("r").alias("r"), F.sum("g").alias("g"), F.sum("b").alias("b"))


_rc = {c: ranges.rescale(Duck, c, ranges.ends(8, k, True), ranges.ends(8, k, False)) for c, k in zip(CHECKED, ("luma", "chroma", "chroma"), strict=True)}
register(
    "rng01_range_of_components", range_components,
    "WITH z AS (SELECT image_id, " + ", ".join(f"{v} AS {c}, {b} AS {c}_broken" for c, (v, b) in _rc.items()) + ") ".replace(") ", "") + " FROM rgb) SELECT image_id, " + ", ".join(f"bool_or({c}_broken) AS {c}_broken" for c in CHECKED) + ", bool_or(r_broken OR g_broken OR b_broken) AS broken, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in CHECKED) + " FROM z GROUP BY image_id", "rgb",
)
register("agg17_any_broken", lambda s, d: range_components(s, d).agg(F.count_if("broken").alias("broken_images"), F.count(F.lit(1)).alias("images")), "WITH z AS (SELECT image_id, " + " OR ".join(b for _, b in _rc.values()) + " AS broken FROM rgb), i AS (SELECT image_id, bool_or(broken) AS broken FROM z GROUP BY image_id) SELECT count(*) FILTER (broken) AS broken_images, count(*) AS images FROM i", "rgb")

# ---- packing ----

_bytes_sql = "bytes AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), "


def text_bytes(s, d) -> DataFrame:
    """doc_id and the UTF-8 bytes of the text as an array of ints."""
    docs = s.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.expr("transform(sequence(1, octet_length(coalesce(text, ''))), i -> cast(conv(substr(hex(encode(coalesce(text, ''), 'UTF-8')), 2 * i - 1, 2), 16, 10) as int))").alias("b"))


for _name, _codec in packing.CODECS.items():
    # groups of bytes: neighbouring samples of a plane stand for the bytes
    _n, _m = _codec.n_bytes, _codec.n_samples
    _groups = 64 // _n

    def _unpacked(s, d, c=_codec, n=_n, m=_m, groups=_groups):
        arr = planes.planes(s, d).drop("label").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        arr = arr.select("image_id", "g", *[F.expr(f"get(v, g * {n} + {i})").alias(f"b{i}") for i in range(n)])
        return arr.select("image_id", "g", *[F.expr(e).alias(f"c{i}") for i, e in enumerate(c.unpack(Spark, [f"b{i}" for i in range(n)]))])

    _byte = ", ".join(f"max(v) FILTER ((8 * y + x) % {_n} = {i}) AS b{i}" for i in range(_n))
    _sql = f"WITH g AS (SELECT image_id, CAST((8 * y + x) // {_n} AS INT) AS g, {_byte} FROM plane WHERE 8 * y + x < {_groups * _n} GROUP BY ALL)"
    _key = f"pck{1 + list(packing.CODECS).index(_name):02d}_{_name.replace('.', '_')}"
    register(f"{_key}_unpack", _unpacked, _sql + " SELECT image_id, g, " + ", ".join(f"{e} AS c{i}" for i, e in enumerate(_codec.unpack(Duck, [f"b{i}" for i in range(_n)]))) + " FROM g", "plane")

    def _packed(s, d, c=_codec, m=_m):
        deep = planes.planes(s, d, 10).drop("label").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(64 // m - 1))))
        deep = deep.select("image_id", "g", *[F.expr(f"get(v, g * {m} + {i}) * {1 << max(0, c.depth - 10)} div {1 << max(0, 10 - c.depth)}").cast("int").alias(f"c{i}") for i in range(m)])
        return deep.select("image_id", "g", *[F.expr(e).alias(f"b{i}") for i, e in enumerate(c.pack(Spark, [f"c{i}" for i in range(m)]))])

    _samples = ", ".join(f"CAST(max(v) FILTER ((8 * y + x) % {_m} = {i}) * {1 << max(0, _codec.depth - 10)} // {1 << max(0, 10 - _codec.depth)} AS INT) AS c{i}" for i in range(_m))
    register(f"{_key}_pack", _packed, f"WITH g AS (SELECT image_id, CAST((8 * y + x) // {_m} AS INT) AS g, {_samples} FROM plane10 GROUP BY ALL) SELECT image_id, g, " + ", ".join(f"{e} AS b{i}" for i, e in enumerate(_codec.pack(Duck, [f"c{i}" for i in range(_m)]))) + " FROM g", "plane10")


def quarter(s, d, order):
    names = {c: c + ("1" if c.islower() else "0") for c in order}
    out = planes.mosaic_planes(planes.planes(s, d).drop("label"), order).drop("v")
    long = planes.samples(out, 4, **{c.lower() + ("2" if c.islower() else "1"): n for c, n in names.items()})
    return long.select(*PIXEL, F.expr("stack(4, " + ", ".join(f"'{c}', {c.lower() + ('2' if c.islower() else '1')}" for c in order) + ") as (plane, v)"))


for _order_name, _order in (("rggb", "RGgB"), ("bggr", "BGgR"), ("ydcc", "YDCc")):
    if len({c.lower() for c in _order}) + sum(c.islower() for c in _order) < 4:
        continue
    register(f"pck15_mosaic_to_planes_{_order_name}", lambda s, d, o=_order: quarter(s, d, o), f"SELECT image_id, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, substr('{_order}', CAST((y % 2) * 2 + x % 2 + 1 AS INT), 1) AS plane, v FROM plane", "plane")
pixel_query("pck18_reorder", "rgb", planes.triples, lambda d: {"c0": "r", "c1": "b", "c2": "g"})

# ---- mosaics and sampling ----


def _near(target: str, colours: dict[str, str], order: str, relation: str, adaptive: bool = False) -> str:
    """Demosaic in SQL: eight joined neighbours at clamped places."""
    of = lambda c: "(" + ", ".join(str(k) for k, o in enumerate(order) if o.lower() == c) + ")"
    parts = []
    for c in "rgb":
        hit = f"((n.y % 2) * 2 + n.x % 2) IN {of(c)}"
        if c == "g" and adaptive:
            pick = lambda dy, dx: f"coalesce(sum(n.v) FILTER (o.dy = {dy} AND o.dx = {dx} AND {hit}), 0)"  # noqa: E731, B023
            n = lambda cond: f"greatest(1, count(*) FILTER ({cond} AND {hit}))"  # noqa: E731, B023
            l, r, t, b = pick(0, -1), pick(0, 1), pick(-1, 0), pick(1, 0)
            across, along = f"abs({l} - {r})", f"abs({t} - {b})"
            e = f"CASE WHEN {across} < {along} THEN ({l} + {r}) // {n('o.dy = 0')} WHEN {across} > {along} THEN ({t} + {b}) // {n('o.dx = 0')} ELSE ({l} + {r} + {t} + {b}) // {n('(o.dy = 0 OR o.dx = 0)')} END"
        else:
            e = f"(sum(n.v) FILTER ({hit})) // greatest(1, count(*) FILTER ({hit}))"
        parts.append(f"CAST(CASE WHEN (m.y % 2) * 2 + m.x % 2 IN {of(c)} THEN any_value(m.v) ELSE {e} END AS INT) AS {c}")
    return f"""WITH o AS (SELECT dy, dx FROM (SELECT unnest([-1, 0, 1]) AS dy) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dx) WHERE dy <> 0 OR dx <> 0)
        SELECT m.image_id, m.y, m.x, {', '.join(parts)} FROM {relation} m CROSS JOIN o
        JOIN {relation} n ON n.image_id = m.image_id AND n.y = least(7, greatest(0, m.y + o.dy)) AND n.x = least(7, greatest(0, m.x + o.dx)) GROUP BY m.image_id, m.y, m.x"""


def demosaiced(s, d, order="RGgB", adaptive=False, depth=8):
    return planes.samples(planes.demosaic(planes.planes(s, d, depth).drop("label"), order, adaptive=adaptive).drop("v"), r="r", g="g", b="b")


for _o, _letters in (("rggb", "RGgB"), ("bggr", "BGgR"), ("grbg", "GRBg"), ("gbrg", "GBRg")):
    register(f"dem01_bilinear_{_o}", lambda s, d, o=_letters: demosaiced(s, d, o), _near("", {}, _letters, "plane"), "plane")
    register(f"dem02_gradient_{_o}", lambda s, d, o=_letters: demosaiced(s, d, o, True), _near("", {}, _letters, "plane", True), "plane")
    register(f"dem06_remosaic_{_o}", lambda s, d, o=_letters: planes.triples(s, d).select(*PIXEL, planes.remosaic(o).alias("v")), "SELECT image_id, y, x, CASE (y % 2) * 2 + x % 2 " + " ".join(f"WHEN {k} THEN {c.lower()}" for k, c in enumerate(_letters)) + " END AS v FROM rgb", "rgb")
register("dem03_bilinear_10bit", lambda s, d: demosaiced(s, d, depth=10), _near("", {}, "RGgB", "plane10"), "plane10")
for _from, _to in ((8, 10), (10, 8), (8, 16), (10, 16)):
    _shift = _to - _from
    _rel = "plane" if _from == 8 else "plane10"
    pixel_query(f"cnv02_depth_{_from}_{_to}", _rel, long_plane(_from), lambda d, k=_shift: {"v": f"(v * {1 << k})" if k > 0 else d.shr("v", -k)})
for _k in ("420", "422"):
    _dy = "2" if _k == "420" else "1"
    register(f"sub01_{_k}", lambda s, d, k=_k: planes.samples(planes.subsample(planes.planes(s, d).drop("label"), k), 4), f"SELECT image_id, CAST(y // {_dy} AS INT) AS y, CAST(x // 2 AS INT) AS x, CAST(sum(v) // {4 if _k == '420' else 2} AS INT) AS v FROM plane GROUP BY image_id, y // {_dy}, x // 2", "plane")
    _odd_y = "greatest(0, least(6, y))"
    register(
        f"sub01_odd_{_k}", lambda s, d, k=_k: planes.samples(planes.subsample(planes.planes(s, d).drop("label").withColumn("v", F.expr(planes.grid(7, 7, "get(v, cast({y} * 8 + {x} as int))"))), k, 7, 7), 4),
        f"""WITH c AS (SELECT image_id, y, x, v FROM plane WHERE y < 7 AND x < 7), e AS (SELECT * FROM c UNION ALL SELECT image_id, y, 7, v FROM c WHERE x = 6), f AS (SELECT * FROM e {"UNION ALL SELECT image_id, 7, x, v FROM e WHERE y = 6" if _k == '420' else ''})
        SELECT image_id, CAST(y // {_dy} AS INT) AS y, CAST(x // 2 AS INT) AS x, CAST(sum(v) // {4 if _k == '420' else 2} AS INT) AS v FROM f GROUP BY image_id, y // {_dy}, x // 2""", "plane",
    )
    register(f"sub02_upsample_{_k}", lambda s, d, k=_k: planes.samples(planes.upsample(planes.subsample(planes.planes(s, d).drop("label"), k), k)), f"""WITH c AS (SELECT image_id, y // {_dy} AS cy, x // 2 AS cx, CAST(sum(v) // {4 if _k == '420' else 2} AS INT) AS v FROM plane GROUP BY ALL)
        SELECT p.image_id, p.y, p.x, c.v FROM plane p JOIN c ON c.image_id = p.image_id AND c.cy = p.y // {_dy} AND c.cx = p.x // 2""", "plane")
register("sub02_upsample_400", lambda s, d: planes.samples(planes.upsample(planes.planes(s, d).drop("label"), "400")), "SELECT image_id, y, x, 128 AS v FROM plane", "plane")
register("sub05_decimate", lambda s, d: planes.samples(planes.decimate(planes.planes(s, d).drop("label")), 4), "SELECT image_id, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, v FROM plane WHERE y % 2 = 0 AND x % 2 = 0", "plane")


def copied(s, d):
    """An 8-bit mosaic to 10-bit 4:2:0: depth first, then colour, then sampling."""
    deep = planes.planes(s, d).drop("label").withColumn("v", F.expr("transform(v, z -> z * 4)"))
    rgb = planes.samples(planes.demosaic(deep, "RGgB").drop("v"), r="r", g="g", b="b")
    yuv = project(rgb, **dict(zip(("l", "u", "w"), colour.rounded_yuv(Spark, list(CHECKED), 10), strict=True)))
    chroma = yuv.groupBy("image_id", F.expr("y div 2").cast("int").alias("y"), F.expr("x div 2").cast("int").alias("x")).agg(F.expr("cast(sum(u) div 4 as int)").alias("u"), F.expr("cast(sum(w) div 4 as int)").alias("v"))
    return yuv.filter("y % 2 = 0 and x % 2 = 0").select("image_id", F.expr("cast(y div 2 as int)").alias("y"), F.expr("cast(x div 2 as int)").alias("x"), "l").join(chroma, list(PIXEL))


_yuv10 = colour.rounded_yuv(Duck, list(CHECKED), 10)
register("cnv01_mosaic_to_yuv420", copied, f"""WITH deep AS (SELECT image_id, y, x, v * 4 AS v FROM plane), rgbx AS ({_near('', {}, 'RGgB', 'deep')}),
    yuv AS (SELECT image_id, y, x, {_yuv10[0]} AS l, {_yuv10[1]} AS u, {_yuv10[2]} AS w FROM rgbx)
    SELECT image_id, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, max(l) FILTER (y % 2 = 0 AND x % 2 = 0) AS l, CAST(sum(u) // 4 AS INT) AS u, CAST(sum(w) // 4 AS INT) AS v FROM yuv GROUP BY image_id, y // 2, x // 2""", "plane")

# ---- filters ----

pixel_query("flt01_copy", "plane", long_plane(), lambda d: {"v": "v"})
register("flt02_gray", lambda s, d: pixels.gray(planes.triples(s, d)), "SELECT image_id, y, x, " + ", ".join(f"{colour.rounded_yuv(Duck, list(CHECKED))[0]} AS {c}" for c in CHECKED) + " FROM rgb", "rgb")
register("flt03_xchroma", lambda s, d: pixels.swap_chroma(planes.triples(s, d), "g", "b").select(*PIXEL, "r", "g", "b"), "SELECT image_id, y, x, r, b AS g, g AS b FROM rgb", "rgb")
register("flt04_tint", lambda s, d: pixels.tint_extremes(planes.triples(s, d).select(*PIXEL, F.expr("case when r < 100 then 1 when r > 150 then 254 else r end").alias("y_"), F.expr("case when g < 140 then 128 else g end").alias("u"), F.expr("case when b < 140 then 128 else b end").alias("v"))),
    """WITH t AS (SELECT image_id, y, x, CASE WHEN r < 100 THEN 1 WHEN r > 150 THEN 254 ELSE r END AS y_, CASE WHEN g < 140 THEN 128 ELSE g END AS u, CASE WHEN b < 140 THEN 128 ELSE b END AS v FROM rgb)
    SELECT image_id, y, x, CASE WHEN u = 128 AND v = 128 AND y_ = 254 THEN 129 WHEN u = 128 AND v = 128 AND y_ = 1 THEN 128 ELSE y_ END AS y_,
    CASE WHEN u = 128 AND v = 128 AND y_ = 254 THEN 48 WHEN u = 128 AND v = 128 AND y_ = 1 THEN 160 ELSE u END AS u,
    CASE WHEN u = 128 AND v = 128 AND y_ = 254 THEN 160 WHEN u = 128 AND v = 128 AND y_ = 1 THEN 48 ELSE v END AS v FROM t""", "rgb")  # fmt: skip
register(
    "flt05_noise", lambda s, d: pixels.noise(long_plane()(s, d), 20),
    "SELECT image_id, y, x, CAST(least(255, greatest(0, v + ('0x' || substr(md5(image_id || ':' || y || ':' || x || ':0'), 1, 8))::BIGINT % 40 - 20)) AS INT) AS v FROM plane", "plane",
)


def _mixed(s, d):
    p = planes.with_neighbours(planes.planes(s, d).drop("label"), 1)
    return pixels.mix(planes.samples(p, y1="v", u1="v", v1="v", y2="v1", u2="v1", v2="v1"), "y1u2v2")


register("flt06_mix", _mixed, "SELECT image_id, y, x, a AS c0, b AS c1, b AS c2 FROM pair", "pair")
for _deg, _yx in ((0, ("y", "x")), (90, ("7 - x", "y")), (180, ("7 - y", "7 - x")), (270, ("x", "7 - y")), (-90, ("x", "7 - y")), (360, ("y", "x"))):
    register(f"flt07_rotate_{str(_deg).replace('-', 'minus')}", lambda s, d, k=_deg: planes.samples(planes.rotate(planes.planes(s, d).drop("label"), k)), f"SELECT image_id, CAST({_yx[0]} AS INT) AS y, CAST({_yx[1]} AS INT) AS x, v FROM plane", "plane")


def _needle(s, d):
    p = planes.with_neighbours(planes.planes(s, d).drop("label"), 2)
    return pixels.crop(planes.samples(p.drop("v"), v="v1", alpha="v2"), 0, 0, 4, 4)


_over = "WITH n AS (SELECT image_id, y + 3 AS y, x + 2 AS x, g AS over, b AS alpha FROM rgb WHERE y < 4 AND x < 4) SELECT p.image_id, p.y, p.x, CAST(CASE WHEN n.over IS NULL THEN p.v ELSE {} END AS INT) AS v FROM plane p LEFT JOIN n USING (image_id, y, x)"
register("flt08_compose", lambda s, d: pixels.compose(long_plane()(s, d), _needle(s, d), 2, 3), _over.format("(p.v + n.over) // 2"), "plane", "rgb")
register("flt08_compose_alpha", lambda s, d: pixels.compose(long_plane()(s, d), _needle(s, d), 2, 3, "alpha"), _over.format("round_even(p.v * (1 - n.alpha / 256::DOUBLE) + n.over * (n.alpha / 256::DOUBLE), 0)"), "plane", "rgb")


def _matched(s, d):
    p = planes.with_neighbours(planes.planes(s, d).drop("label"), 1)
    needle = p.select("image_id", F.expr("transform(sequence(0, 8), k -> get(v1, cast((k div 3 + 2) * 8 + k % 3 + 3 as int)))").alias("v"))
    return pixels.match(p.select("image_id", "v"), needle, 8, 8, 3)


register("flt09_match", _matched, """WITH t AS (SELECT image_id, y - 2 AS ty, x - 3 AS tx, b AS t FROM pair WHERE y BETWEEN 2 AND 4 AND x BETWEEN 3 AND 5),
    o AS (SELECT oy, ox FROM (SELECT unnest(range(6)) AS oy) CROSS JOIN (SELECT unnest(range(6)) AS ox)),
    s AS (SELECT p.image_id, oy, ox, sum(t) AS st, sum(p.v) AS si, sum(t * t) AS stt, sum(p.v * p.v) AS sii, sum(t * p.v) AS sti
        FROM t CROSS JOIN o JOIN plane p ON p.image_id = t.image_id AND p.y = oy + ty AND p.x = ox + tx GROUP BY ALL),
    c AS (SELECT image_id, oy, ox, CASE WHEN (9 * stt - st * st) * (9 * sii - si * si) <= 0 THEN 0.0::DOUBLE
        ELSE round((9 * sti - st * si)::DOUBLE / sqrt(((9 * stt - st * st) * (9 * sii - si * si))::DOUBLE), 9) END AS score FROM s)
    SELECT image_id, CAST(oy AS INT) AS y, CAST(ox AS INT) AS x, score FROM c QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, oy, ox) = 1""", "plane", "pair")
register(
    "flt10_affine_shift", lambda s, d: planes.samples(pixels.affine(planes.planes(s, d).drop("label"), [[1, 0, 2], [0, 1, 1]], 8, 8)),
    "SELECT image_id, y, x, CASE WHEN y >= 1 AND x >= 2 THEN l[(y - 1) * 8 + x - 2 + 1] ELSE 0 END AS v FROM spot", "spot",
)
_SWAP = pixels.affine_matrix([(0, 0), (1, 0), (0, 1)], [(0, 0), (0, 1), (1, 0)])
register("flt11_affine_points", lambda s, d: planes.samples(pixels.affine(planes.planes(s, d).drop("label"), _SWAP, 8, 8)), "SELECT image_id, y, x, l[x * 8 + y + 1] AS v FROM spot", "spot")
_luma = "CAST(round_even(least(255.0::DOUBLE, greatest(0.0::DOUBLE, abs(a - b) * {}::DOUBLE)), 0) AS INT)"
register("flt12_diff_luma", lambda s, d: pixels.difference(planes.pairs(s, d), 1.5), f"SELECT image_id, y, x, {_luma.format(1.5)} AS luma, 128 AS u, 128 AS v FROM pair", "pair")
register("flt12_diff_inverted", lambda s, d: pixels.difference(planes.pairs(s, d), 2.5, True), f"SELECT image_id, y, x, 255 - {_luma.format(2.5)} AS luma, 128 AS u, 128 AS v FROM pair", "pair")
register("flt13_diff_colour", lambda s, d: pixels.difference(planes.pairs(s, d), 1.0, False, 2.0), f"SELECT image_id, y, x, {_luma.format(1.0)} AS luma, CAST(least(255, greatest(0, trunc(255 - (2.0::DOUBLE * (a - b) + 255) / 2))) AS INT) AS u, CAST(least(255, greatest(0, trunc((2.0::DOUBLE * (a - b) + 255) / 2))) AS INT) AS v FROM pair", "pair")
register("flt14_roi", lambda s, d: pixels.crop(long_plane()(s, d), 2, 1, 7, 5), "SELECT image_id, y, x, v FROM plane WHERE y >= 1 AND y < 5 AND x >= 2 AND x < 7", "plane")
register("flt16_diff_10bit", lambda s, d: pixels.difference(planes.pairs(s, d, 10), 1.5, True, top=1023), "SELECT image_id, y, x, 1023 - CAST(round_even(least(1023.0::DOUBLE, greatest(0.0::DOUBLE, abs(a - b) * 1.5::DOUBLE)), 0) AS INT) AS luma, 512 AS u, 512 AS v FROM pair10", "pair10")
register("flt20_align", lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", pixels.align("p_size", 8).cast("int").alias("aligned")), "SELECT p_partkey, CAST(8 * (p_size // 8) AS INT) AS aligned FROM part")
register("flt21_dimensions", lambda s, d: long_plane()(s, d).groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")), "SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM plane GROUP BY image_id", "plane")

# ---- metrics ----

_st = lambda c: f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std"
register("agg01_component_stats", lambda s, d: metrics.stats(planes.triples(s, d), list(CHECKED), ["image_id"]), f"SELECT image_id, {', '.join(_st(c) for c in CHECKED)} FROM rgb GROUP BY image_id", "rgb")
register("agg01_roi_stats", lambda s, d: metrics.stats(pixels.crop(planes.triples(s, d), 2, 2, 6, 6), list(CHECKED), ["image_id"]), f"SELECT image_id, {', '.join(_st(c) for c in CHECKED)} FROM rgb WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 GROUP BY image_id", "rgb")
register("agg02_histogram", lambda s, d: metrics.histogram(long_plane()(s, d)), "SELECT CAST(i AS INT) AS value, count(v) AS hist, round(count(v) / (SELECT count(*) FROM plane), 9) AS ratio FROM (SELECT unnest(range(256)) AS i) LEFT JOIN plane ON v = i GROUP BY i", "plane")
register("agg03_mse", lambda s, d: metrics.mse(long_plane()(s, d), ["image_id"]), "SELECT image_id, round(avg(v * v), 6) AS mse FROM plane GROUP BY image_id", "plane")
register("agg03_mse_inverted", lambda s, d: metrics.mse(long_plane()(s, d), ["image_id"], 255), "SELECT image_id, round(avg((255 - v) * (255 - v)), 6) AS mse FROM plane GROUP BY image_id", "plane")
register("agg04_psnr_zero", lambda s, d: metrics.mse(long_plane()(s, d), ["image_id"]).select("image_id", F.round(metrics.psnr_zero(F.col("mse"), 255), 6).alias("psnr")), "SELECT image_id, round(20 * log10(255::DOUBLE) - 10 * log10(round(avg(v * v), 6)), 6) AS psnr FROM plane GROUP BY image_id", "plane")
register("agg05_diff_energy", lambda s, d: metrics.diff_energy(planes.pairs(s, d), ["image_id"]), "SELECT image_id, round(avg(abs(a - b)), 6) AS diff_mean, round(stddev_pop(abs(a - b)), 6) AS diff_std FROM pair GROUP BY image_id", "pair")
register("agg06_psnr", lambda s, d: metrics.psnr(planes.pairs(s, d), ["image_id"]), "SELECT image_id, round(avg((a - b) * (a - b)), 6) AS mse, round(10 * log10(65025::DOUBLE / avg((a - b) * (a - b))), 6) AS psnr FROM pair GROUP BY image_id", "pair")
register("agg06_psnr_equal", lambda s, d: metrics.psnr(planes.pairs(s, d).withColumn("b", F.col("a")), ["image_id"], floor_area=True), "SELECT image_id, 0.0::DOUBLE AS mse, round(10 * log10(65025::DOUBLE * count(*)), 6) AS psnr FROM pair GROUP BY image_id", "pair")


def _psnr_planes(s, d):
    p = planes.pairs(s, d).withColumn("plane", F.expr("substr('RGgB', (y % 2) * 2 + x % 2 + 1, 1)"))
    own = metrics.psnr(p, ["image_id", "plane"])
    return own.groupBy("image_id").agg(F.round(F.avg("psnr"), 8).alias("psnr"), F.count(F.lit(1)).alias("planes"))


register("agg07_psnr_of_planes", _psnr_planes, """WITH q AS (SELECT image_id, y % 2 AS py, x % 2 AS px, round(10 * log10(65025::DOUBLE / avg((a - b) * (a - b))), 6) AS psnr FROM pair GROUP BY ALL)
    SELECT image_id, round(avg(psnr), 8) AS psnr, count(*) AS planes FROM q GROUP BY image_id""", "pair")
register("agg08_aepp", lambda s, d: metrics.aepp(planes.pairs(s, d), ["image_id"]), "SELECT image_id, round(avg(abs(a - b)), 6) AS aepp FROM pair GROUP BY image_id", "pair")
register("agg14_band_stats", lambda s, d: metrics.bands(long_plane()(s, d), 4, 8), f"SELECT image_id, CAST(y // 2 AS INT) AS band, {_st('v')} FROM plane WHERE y % 2 = 0 GROUP BY image_id, y // 2", "plane")
register("agg15_ssim", lambda s, d: metrics.ssim(planes.pairs(s, d), ["image_id"]), """WITH m AS (SELECT image_id, avg(a) AS ma, avg(b) AS mb, avg(a * a) AS aa, avg(b * b) AS bb, avg(a * b) AS ab FROM pair GROUP BY image_id)
    SELECT image_id, round(((2 * ma * mb + 6.5025::DOUBLE) * (2 * (ab - ma * mb) + 58.5225::DOUBLE)) / ((ma * ma + mb * mb + 6.5025::DOUBLE) * (aa - ma * ma + bb - mb * mb + 58.5225::DOUBLE)), 6) AS ssim FROM m""", "pair")
register("joi02_aligned", lambda s, d: planes.pairs(s, d), "SELECT image_id, y, x, a, b FROM pair", "pair")
register("win04_neighbours", lambda s, d: planes.samples(planes.planes(s, d).drop("label").withColumns({n: F.expr(planes.grid(8, 8, planes.at("v", y, x, 8, 8))) for n, y, x in (("l", "{y}", "{x} - 1"), ("r", "{y}", "{x} + 1"), ("t", "{y} - 1", "{x}"), ("b", "{y} + 1", "{x}"))}), l="l", r="r", t="t", b="b").select(*PIXEL, "l", "r", "t", "b"),
    """SELECT image_id, y, x, coalesce(lag(v) OVER (PARTITION BY image_id, y ORDER BY x), v) AS l, coalesce(lead(v) OVER (PARTITION BY image_id, y ORDER BY x), v) AS r,
    coalesce(lag(v) OVER (PARTITION BY image_id, x ORDER BY y), v) AS t, coalesce(lead(v) OVER (PARTITION BY image_id, x ORDER BY y), v) AS b FROM plane""", "plane")  # fmt: skip
register("srt04_argmax", lambda s, d: long_plane()(s, d).groupBy("image_id").agg(F.max(F.struct("v", (-(8 * F.col("y") + F.col("x"))).alias("k"))).alias("m")).select("image_id", F.col("m.v").alias("v"), (-F.col("m.k")).alias("place")), "SELECT image_id, v, 8 * y + x AS place FROM plane QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY v DESC, 8 * y + x) = 1", "plane")
register("set04_two_valued", lambda s, d: planes.extremes(planes.planes(s, d)).select("image_id", F.expr("forall(v, z -> z in (0, 255))").alias("two"), F.expr("exists(v, z -> z = 255)").alias("has_top")), "SELECT image_id, bool_and(v IN (0, 255)) AS two, bool_or(v = 255) AS has_top FROM ext GROUP BY image_id", "ext")

# ---- block codecs ----

for _c in blocks.CODECS:
    _prep = blocks.prepared(_c).replace("shiftright(v, ", "(v >> ")
    _top = (1 << int(_c[-1])) - 1 if _c.startswith("resolution-") else 255
    _bits = blocks.payload_bits(_c, 2)
    _two = f"WHEN bool_and(s IN (0, {_top})) THEN '11'" if _c == "bitmap" else ""
    _tags = f"t AS (SELECT image_id, CAST(y // 2 AS INT) AS block_y, CAST(x // 2 AS INT) AS block_x, CASE WHEN max(s) = 0 THEN '00' WHEN min(s) = {_top} THEN '01' {_two} ELSE '10' END AS tag FROM (SELECT image_id, y, x, {_prep} AS s FROM ext) GROUP BY image_id, y // 2, x // 2)"
    _sized = "CASE tag " + " ".join(f"WHEN '{t}' THEN {n + 2}" for t, n in _bits.items()) + " END"
    _key = {"warhol": "alp01_warhol", "warhol2": "alp02_warhol2", "bitmap": "alp03_bitmap"}.get(_c, "alp04_" + _c.replace("-", ""))
    _long = lambda s, d: planes.samples(planes.extremes(planes.planes(s, d)).drop("label"))
    register(_key, lambda s, d, c=_c: blocks.block_tags(planes.samples(planes.extremes(planes.planes(s, d)).drop("label")), c, 2), f"WITH {_tags} SELECT image_id, block_y, block_x, tag, {_sized} AS bits FROM t", "ext")
    register(f"agg12_tags_{_c.replace('-', '')}", lambda s, d, c=_c: blocks.tag_counts(blocks.block_tags(planes.samples(planes.extremes(planes.planes(s, d)).drop("label")), c, 2)), f"WITH {_tags} SELECT image_id, " + ", ".join(f"count(*) FILTER (tag = '{t}') AS n{t}" for t in _bits) + f", CAST((sum({_sized}) + 7) // 8 AS BIGINT) AS n_bytes FROM t GROUP BY image_id", "ext")


def _round_trip(s, d):
    """Planes of all values in blocks of 3, so that they are filled up and cut again, at 4 bits."""
    p = planes.planes(s, d).select("image_id", "v")
    return planes.samples(blocks.decode_planes(blocks.encode_planes(p, "resolution-4", 8, 8, 3)))


register("alp05_file_round_trip", _round_trip, "SELECT image_id, y, x, (v >> 4) << 4 AS v FROM plane", "plane")
