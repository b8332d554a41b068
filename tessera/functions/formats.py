"""The pixel-format registry, built from families, and what follows from a format: sizes, plane resolutions, containers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .packing import CODECS


@dataclass(frozen=True)
class Format:
    name: str
    component: str  # bayer, ydgcocg, rgb, yuv
    layout: str  # packed, planar
    order: str  # a plane's letter for each place of the 2 x 2 cell, or the planes in order
    depth: int
    codec: str | None = None
    subsample: str | None = None  # 420, 422, 444
    container: str = "mono"  # colour space that a Y4M stream of it uses
    ffmpeg: bool = False
    aliases: tuple[str, ...] = ()
    n_bytes: int | None = None  # of a group, and its samples
    n_samples: int | None = None


# Colour-filter orders (first and second green are G and g) and the public codes of formats.
ORDERS = {"rggb": "RGgB", "grbg": "GRBg", "gbrg": "GBRg", "bggr": "BGgR"}
OTHER_ORDERS = {"ggbr": "GgBR", "ggrb": "GgRB", "rgbg": "RGBg", "bgrg": "BGRg"}
EXPANDED = {10: {"rggb": "RG10", "grbg": "BA10", "gbrg": "GB10", "bggr": "BG10"}, 12: {"rggb": "RG12", "grbg": "BA12", "gbrg": "GB12", "bggr": "BG12"}, 14: {"rggb": "RG14", "grbg": "GR14", "gbrg": "GB14", "bggr": "BG14"}}
PACKED_SUFFIX = {10: "AA", 12: "CC", 14: "EE"}
PACKED_PREFIX = {"rggb": "pR", "grbg": "pg", "gbrg": "pG", "bggr": "pB"}
COMPRESSED = {"alaw": {"rggb": "aRA8", "bggr": "aBA8", "gbrg": "aGA8", "grbg": "agA8"}, "dpcm": {"rggb": "bRA8", "bggr": "bBA8", "gbrg": "bGA8", "grbg": "BD10"}, "ipu3": {"rggb": "ip3r", "bggr": "ip3b", "gbrg": "ip3g", "grbg": "ip3G"}}
CODES_8 = {"bggr": "BA81", "rggb": "RGGB", "gbrg": "GBRG", "grbg": "GRBG"}
CODES_16 = {"bggr": ("BA82", "BYR2"), "rggb": ("RG16",), "gbrg": ("GB16",), "grbg": ("GR16",)}
#: Y4M colour spaces: chroma subsampling and depth.
COLOUR_SPACES = {
    "mono": ("400", 8), "mono10": ("400", 10), "mono12": ("400", 12), "mono14": ("400", 14), "mono16": ("400", 16), "420": ("420", 8), "420jpeg": ("420", 8),
    "420paldv": ("420", 8), "420mpeg2": ("420", 8), "422": ("422", 8), "444": ("444", 8), "420p10": ("420", 10), "422p10": ("422", 10), "444p10": ("444", 10),
}


def _registry() -> dict[str, Format]:
    out: list[Format] = []

    def packed(name, order, depth, codec, **more):
        c = CODECS.get(codec)
        n = {"10.alaw": (2, 2), "10.dpcm": (2, 2), "10.ipu3": (32, 25)}.get(codec) or (c.n_bytes, c.n_samples)
        out.append(Format(name, "bayer", "packed", order, depth, codec, n_bytes=n[0], n_samples=n[1], **more))

    for o, letters in (ORDERS | OTHER_ORDERS).items():
        packed(f"bayer_{o}8", letters, 8, "8", ffmpeg=True, aliases=(CODES_8[o], f"S{o.upper()}8") if o in ORDERS else ())
    for depth, names in EXPANDED.items():
        for o, name in names.items():
            v4l = f"S{o.upper()}{depth}"
            packed(name, ORDERS[o], depth, str(depth), container=f"mono{depth}", aliases=(v4l, f"bayer_{o}10") if depth == 10 else (v4l,))
            packed(PACKED_PREFIX[o] + PACKED_SUFFIX[depth], ORDERS[o], depth, f"{depth}.packed", aliases=(v4l + "P", f"MIPI-RAW10-{o.upper()}") if depth == 10 else (v4l + "P",))
            if depth == 10:
                out.append(Format(name + ".planar", "bayer", "planar", ORDERS[o], 10, container="mono10", aliases=(v4l + ".planar", f"bayer_{o}10.planar")))
    for kind, names in COMPRESSED.items():
        for o, name in names.items():
            packed(name, ORDERS[o], 10, f"10.{kind}", aliases=(f"IPU3_S{o.upper()}10" if kind == "ipu3" else f"S{o.upper()}10{kind.upper()[:4] if kind == 'dpcm' else 'ALAW'}8",))
    for o, letters in ORDERS.items():
        packed(f"bayer_{o}16le", letters, 16, "16le", ffmpeg=True, container="mono16", aliases=(*CODES_16[o], f"S{o.upper()}16"))
        packed(f"bayer_{o}16be", letters, 16, "16be", ffmpeg=True)
        out.append(Format(f"bayer_{o}8.planar", "bayer", "planar", letters, 8, aliases=(CODES_8[o] + ".planar", f"S{o.upper()}8.planar")))
    for depth in (8, 10):
        mono, p = ("mono", "") if depth == 8 else ("mono10", "p10")
        out.append(Format(f"ydgcocg{depth}.packed", "ydgcocg", "packed", "YDCc", depth, str(depth), container=mono, n_bytes=2 if depth == 8 else 4, n_samples=2))
        out.append(Format(f"ydgcocg{depth}.planar", "ydgcocg", "planar", "YDCc", depth, container=mono))
        out.append(Format(f"ydgcocg420p{depth}.planar", "ydgcocg", "planar", "YDCc", depth, subsample="420", container=mono))
        out.append(Format(f"rgb{depth}.planar", "rgb", "planar", "rgb", depth, container=mono))
        for s in ("420", "422", "444"):
            out.append(Format(f"yuv{s}p{depth}", "yuv", "planar", "yuv", depth, subsample=s, container=s + p))
            out.append(Format(f"yuv{s}p{depth}.mono", "yuv", "planar", "yuv", depth, subsample=s, container=mono))
    return {f.name: f for f in out}


FORMATS = _registry()
ALIASES = {a: f.name for f in FORMATS.values() for a in f.aliases}


def canonical(name: str) -> Format:
    """A format by its name or an alias."""
    key = ALIASES.get(name, name)
    if key not in FORMATS:
        raise ValueError(f"an unknown pixel format: {name}")
    return FORMATS[key]


def formats_table(spark: SparkSession) -> DataFrame:
    rows = [(f.name, f.component, f.layout, f.order, f.depth, f.subsample, f.container, f.ffmpeg, f.n_bytes, f.n_samples) for f in FORMATS.values()]
    return spark.createDataFrame(rows, "name string, component string, layout string, plane_order string, depth int, subsample string, container string, ffmpeg boolean, n_bytes int, n_samples int")


def aliases_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ALIASES.items()), "alias string, name string")


# Rules as SQL over the columns of formats_table and width w, height h.


def buffer_size_sql(d) -> str:
    each = "(case when depth = 8 then 1 else 2 end)"
    half = lambda x: d.div(f"({x} + 1)", 2)
    return f"""case
        when layout = 'packed' then {d.div('(w * h * n_bytes)', 'n_samples')}
        when component = 'ydgcocg' and subsample = '420' then (2 * {d.div('w', 2)} * {d.div('h', 2)} + {d.div('w', 2)} * {d.div('h', 4)}) * {each}
        when component in ('bayer', 'ydgcocg') then w * h * {each}
        when component = 'rgb' then 3 * w * h * {each}
        when subsample = '444' then 3 * w * h * {each}
        when subsample = '422' then (w * h + 2 * {half('w')} * h) * {each}
        else (w * h + 2 * {half('w')} * {half('h')}) * {each} end"""


def plane_size_sql(d, plane: str) -> tuple[str, str]:
    """Width and height of a plane (a letter held by the column or literal `plane`)."""
    w2, h2 = d.div("w", 2), d.div("h", 2)
    width = f"""case when component = 'bayer' then {w2} when component = 'ydgcocg' then case when subsample = '420' and {plane} in ('C', 'c') then {d.div('w', 4)} else {w2} end
        when component = 'rgb' or {plane} = 'y' or subsample = '444' then w else {w2} end"""
    height = f"""case when component = 'bayer' then {h2} when component = 'ydgcocg' then case when subsample = '420' and {plane} in ('C', 'c') then {d.div('h', 4)} else {h2} end
        when component = 'rgb' or {plane} = 'y' or subsample in ('444', '422') then h else {h2} end"""
    return width, height


def container_size_sql(d) -> tuple[str, str]:
    """Width and height of the Y4M stream that holds a w x h image."""
    wide = f"case when container = 'mono' and depth > 8 then {d.div('(w * n_bytes)', 'n_samples')} else w end"
    width = f"case when layout = 'packed' then {wide} when component in ('bayer', 'ydgcocg') then {d.div('w', 2)} else w end"
    height = f"""case when layout = 'packed' then h when component = 'ydgcocg' and subsample = '420' then {d.div('(5 * h)', 4)} when component in ('bayer', 'ydgcocg') then 2 * h
        when component = 'rgb' then 3 * h when container not in ('mono', 'mono10') then h when subsample = '444' then 3 * h when subsample = '422' then 2 * h else {d.div('(3 * h)', 2)} end"""
    return width, height


def image_size_sql(d) -> tuple[str, str]:
    """Width and height of the image in a w x h stream: the inverse of container_size_sql."""
    wide = f"case when container = 'mono' and depth > 8 then {d.div('(w * n_samples)', 'n_bytes')} else w end"
    width = f"case when layout = 'packed' then {wide} when component in ('bayer', 'ydgcocg') then 2 * w else w end"
    height = f"""case when layout = 'packed' then h when component = 'ydgcocg' and subsample = '420' then {d.div('(4 * h)', 5)} when component in ('bayer', 'ydgcocg') then {d.div('h', 2)}
        when component = 'rgb' then {d.div('h', 3)} when container not in ('mono', 'mono10') then h when subsample = '444' then {d.div('h', 3)} when subsample = '422' then {d.div('h', 2)} else {d.div('(2 * h)', 3)} end"""
    return width, height


def frame_geometry_sql(d, space: str = "space", ceil: bool = True) -> dict[str, str]:
    """Chroma size, pixels and bytes of a Y4M frame of w x h by colour space."""
    up = 1 if ceil else 0
    kind = "case " + " ".join(f"when {space} = '{k}' then '{s}'" for k, (s, _) in COLOUR_SPACES.items()) + " end"
    depth = "case " + " ".join(f"when {space} = '{k}' then {n}" for k, (_, n) in COLOUR_SPACES.items()) + " end"
    cw = f"case {kind} when '400' then 0 when '444' then w else {d.div(f'(w + {up})', 2)} end"
    ch = f"case {kind} when '400' then 0 when '420' then {d.div(f'(h + {up})', 2)} else h end"
    pixels = f"(w * h + 2 * ({cw}) * ({ch}))"
    return {"subsample": kind, "depth": depth, "chroma_w": cw, "chroma_h": ch, "frame_pixels": pixels, "frame_bytes": f"({pixels} * case when {depth} = 8 then 1 else 2 end)"}


#: Bytes of a frame to its pixels, by raw pixel format, as (numerator, denominator).
RAW_FACTORS = {"yuv420p": (3, 2), "nv12": (3, 2), "yuyv422": (2, 1), "yuv444p": (3, 1), "rgb24": (3, 1), "rgba": (4, 1)}


def raw_offsets_sql(d, fmt: str = "fmt") -> list[str]:
    """Byte offsets of the three components of pixel (i, j) in a raw frame of w x h."""
    wh, wj = "(w * h)", "(w * j)"
    c420 = f"({d.div('w', 2)} * {d.div('j', 2)} + {d.div('i', 2)})"
    quarter = f"({d.div('w', 2)} * {d.div('h', 2)})"
    nv = f"({wh} + {d.div('w', 2)} * 2 * {d.div('j', 2)} + 2 * {d.div('i', 2)})"
    first = "(i % 2 = 0)"
    rows = [
        (f"{wj} + i", f"{wh} + {c420}", f"{wh} + {quarter} + {c420}"),
        (f"{wj} + i", nv, f"{nv} + 1"),
        (f"{wj} + i", f"{wh} + {wj} + i", f"2 * {wh} + {wj} + i"),
        (f"2 * {wj} + 2 * i", f"2 * {wj} + 2 * i + case when {first} then 1 else -1 end", f"2 * {wj} + 2 * i + case when {first} then 3 else 1 end"),
        tuple(f"3 * {wj} + 3 * i + {k}" for k in range(3)),
        tuple(f"4 * {wj} + 4 * i + {k}" for k in range(3)),
    ]
    names = ("yuv420p", "nv12", "yuv444p", "yuyv422", "rgb24", "rgba")
    return [f"case {fmt} " + " ".join(f"when '{n}' then {r[k]}" for n, r in zip(names, rows, strict=True)) + " end" for k in range(3)]
