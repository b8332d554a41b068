"""Colour spaces: RGB to luma and chroma and back, one formula a component.

A conversion is a `Linear` (a shift of the inputs, a 3 x 3 matrix, a scale and offset, a finish) or a function of its own. All are SQL
expressions over three components; conversions of images are projections, without a shuffle or Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import full_to_limited, limited_to_full
from .sql import Spark, away, clip, floor_int


@dataclass(frozen=True)
class Linear:
    rows: tuple
    shift: tuple = (0, 0, 0)  # taken from the inputs
    divide: float = 1.0  # of the inputs, after the shift
    scale: float = 1.0
    add: tuple = (0, 0, 0)
    studio: str = ""  # "in": inputs become limited range first; "out": outputs become full range
    finish: str = "clip"  # clip (to 0..255, cut), cut, none

    def sql(self, d, xs: list[str]) -> list[str]:
        if self.studio == "in":
            xs = [full_to_limited(d, x, 235) for x in xs]
        ins = [f"({x} - {s})" if s else x for x, s in zip(xs, self.shift, strict=True)]
        if self.divide != 1:
            ins = [f"({x} / {d.num(self.divide)})" for x in ins]
        out = []
        for row, add in zip(self.rows, self.add, strict=True):
            terms = [f"{d.num(k)} * {x}" for k, x in zip(row, ins, strict=True) if k]
            y = "(" + " + ".join(terms) + ")"
            if self.scale != 1:
                y = f"({d.num(self.scale)} * {y})"
            if add:
                y = f"({y} + {add})"
            if self.finish == "clip":
                y = d.trunc(clip(y, 0, 255))
            elif self.finish == "cut":
                y = d.trunc(y)
            out.append(limited_to_full(d, y, 235) if self.studio == "out" else y)
        return out


# Published conversion coefficients (rows: luma, blue-difference, red-difference; or red, green, blue).
LINEAR = {
    ("yiq", "rgb2yuv"): Linear(((0.299, 0.587, 0.114), (0.596, -0.275, -0.321), (0.212, -0.523, 0.311)), finish="none"),
    ("yiq", "yuv2rgb"): Linear(((1.0, 0.956, 0.621), (1.0, -0.272, -0.647), (1.0, -1.107, 1.704)), finish="none"),
    ("sdtv.basic", "rgb2yuv"): Linear(((0.299, 0.587, 0.114), (-0.147, -0.289, 0.436), (0.615, -0.515, -0.1))),
    ("sdtv.basic", "yuv2rgb"): Linear(((1.0, 0.0, 1.14), (1.0, -0.395, -0.581), (1.0, 2.032, 0.0))),
    ("sdtv.analog", "rgb2yuv"): Linear(((0.299, 0.587, 0.114), (-0.169, -0.331, 0.5), (0.5, -0.419, -0.081)), divide=256.0, scale=256.0, add=(0, 128, 128), finish="cut"),
    ("sdtv.analog", "yuv2rgb"): Linear(((1.0, 0.0, 1.402), (1.0, -0.344, -0.714), (1.0, 1.772, 0.0)), shift=(0, 128, 128), divide=256.0, scale=256.0),
    ("sdtv.digital", "rgb2yuv"): Linear(((0.299, 0.587, 0.114), (-0.172, -0.339, 0.511), (0.511, -0.428, -0.083)), add=(0, 128, 128), studio="in"),
    ("sdtv.digital", "yuv2rgb"): Linear(((1.0, 0.0, 1.371), (1.0, -0.336, -0.698), (1.0, 1.732, 0.0)), shift=(0, 128, 128), studio="out", finish="none"),
    ("sdtv.computer", "rgb2yuv"): Linear(((0.257, 0.504, 0.098), (-0.148, -0.291, 0.439), (0.439, -0.368, -0.071)), add=(16, 128, 128)),
    ("sdtv.computer", "yuv2rgb"): Linear(((1.164, 0.0, 1.596), (1.164, -0.391, -0.813), (1.164, 2.018, 0.0)), shift=(16, 128, 128)),
    ("hdtv.basic", "rgb2yuv"): Linear(((0.2126, 0.7152, 0.0722), (-0.09991, -0.33609, 0.436), (0.615, -0.55861, -0.05639))),
    ("hdtv.basic", "yuv2rgb"): Linear(((1.0, 0.0, 1.28033), (1.0, -0.21482, -0.38059), (1.0, 2.12798, 0.0))),
    ("hdtv.analog", "rgb2yuv"): Linear(((0.213, 0.715, 0.072), (-0.115, -0.385, 0.5), (0.5, -0.454, -0.046)), divide=256.0, scale=256.0, add=(0, 128, 128), finish="cut"),
    ("hdtv.analog", "yuv2rgb"): Linear(((1.0, 0.0, 1.575), (1.0, -0.187, -0.468), (1.0, 1.856, 0.0)), shift=(0, 128, 128), divide=256.0, scale=256.0),
    ("hdtv.digital", "rgb2yuv"): Linear(((0.213, 0.715, 0.072), (-0.117, -0.394, 0.511), (0.511, -0.464, -0.047)), add=(0, 128, 128), studio="in", finish="none"),
    ("hdtv.digital", "yuv2rgb"): Linear(((1.0, 0.0, 1.54), (1.0, -0.183, -0.459), (1.0, 1.816, 0.0)), shift=(0, 128, 128), studio="out", finish="none"),
    ("hdtv.computer", "rgb2yuv"): Linear(((0.183, 0.614, 0.062), (-0.101, -0.338, 0.439), (0.439, -0.399, -0.04)), add=(16, 128, 128)),
    ("hdtv.computer", "yuv2rgb"): Linear(((1.164, 0.0, 1.793), (1.164, -0.213, -0.534), (1.164, 2.115, 0.0)), shift=(16, 128, 128)),
}
#: Fixed values of Rec. ITU-T H.273: weights of red and blue by matrix coefficients number.
H273_WEIGHTS = {1: (0.2126, 0.0722), 4: (0.30, 0.11), 5: (0.299, 0.114), 6: (0.299, 0.114), 7: (0.212, 0.087), 9: (0.2627, 0.0593), 10: (0.2627, 0.0593)}
H273_NUMBERS = (0, 1, 4, 5, 6, 7, 8, 9, 10, 11, 14)


def ycocg(d, x: list[str], forward: bool) -> list[str]:
    a, b, c = x
    if not forward:
        return [f"({a} + {b} + {c})", f"({a} + {c})", f"({a} - {b} - {c})"]
    return [f"({d.shr(a, 2)} + {d.shr(b, 1)} + {d.shr(c, 2)})", f"({d.shr(a, 1)} - {d.shr(c, 1)})", f"({d.shr(f'(0 - {a})', 2)} + {d.shr(b, 1)} - {d.shr(c, 2)})"]


def ycocgr(d, x: list[str], forward: bool) -> list[str]:
    """The lossless variant."""
    if forward:
        r, g, b = x
        co = f"({r} - {b})"
        t = f"({b} + {d.shr(co, 1)})"
        cg = f"({g} - {t})"
        return [f"({t} + {d.shr(cg, 1)})", co, cg]
    y, co, cg = x
    t = f"({y} - {d.shr(cg, 1)})"
    b = f"({t} - {d.shr(co, 1)})"
    return [f"({b} + {co})", f"({cg} + {t})", b]


def to_unit(d, x: str, span: float, limited: bool) -> str:
    return f"(({x} - 16) / {d.num(span)})" if limited else f"({x} / {d.num(255.0)})"


def from_unit_luma(d, x: str, limited: bool) -> str:
    return clip(away(f"({d.num(219.0)} * {x} + 16)" if limited else f"({d.num(255.0)} * {x})"), 0, 255)


def from_unit_chroma(d, x: str, limited: bool, standard: bool = False) -> str:
    """Limited chroma has no offset of 16 unless `standard`."""
    return clip(away((f"({d.num(224.0)} * {x}" + (" + 16)" if standard else ")")) if limited else f"({d.num(255.0)} * {x})"), 0, 255)


def affine(d, matrix, xs: list[str]) -> list[str]:
    """Rows of a matrix times the inputs; a fourth column is a constant."""
    out = []
    for row in np.asarray(matrix, float):
        terms = [f"{d.num(float(k))} * {x}" for k, x in zip(row[:3], xs, strict=True) if k]
        if len(row) > 3 and row[3]:
            terms.append(d.num(float(row[3])))
        out.append("(" + " + ".join(terms) + ")")
    return out


def h273_matrix(mc: int) -> np.ndarray:
    """RGB to Y and chroma around 0.5, all in 0..1, for the numbers that a matrix expresses."""
    if mc in H273_WEIGHTS:
        r, b = H273_WEIGHTS[mc]
        g = 1 - r - b
        return np.array([[r, g, b, 0], [-r / (2 - 2 * b), -g / (2 - 2 * b), 0.5, 0.5], [0.5, -g / (2 - 2 * r), -b / (2 - 2 * r), 0.5]])
    if mc == 11:
        return np.array([[0, 1, 0, 0], [0, -0.5, 0.986566 / 2, 0.5], [0.5, -0.991902 / 2, 0, 0.5]])
    if mc == 14:
        lms = np.array([[1688, 2146, 262], [683, 2951, 462], [99, 309, 3688]]) / 4096
        ictcp = np.array([[2048, 2048, 0], [6610, -13613, 7003], [17933, -17390, -543]]) / 4096
        return np.hstack([ictcp @ lms, [[0], [0.5], [0.5]]])
    raise ValueError(f"matrix coefficients {mc} are not supported")


def h273(d, x: list[str], mc: int, forward: bool, yuv_limited: bool = False, rgb_limited: bool = False, standard: bool = False) -> list[str]:
    """H.273 matrix coefficients over 8-bit components."""
    half = 128
    if mc == 0:
        order = (1, 2, 0) if forward else (2, 0, 1)
        return [clip(x[i], 0, 255) for i in order]
    if mc == 8:
        if forward:
            r, g, b = x
            parts = [away(f"({d.num(0.5)} * {g} + {d.num(0.25)} * ({r} + {b}))"), away(f"({d.num(0.5)} * {g} - {d.num(0.25)} * ({r} + {b}))") + f" + {half}", away(f"({d.num(0.5)} * ({r} - {b}))") + f" + {half}"]
        else:
            y, cb, cr = x
            t = f"({y} - ({cb} - {half}))"
            parts = [f"({t} + ({cr} - {half}))", f"({y} + ({cb} - {half}))", f"({t} - ({cr} - {half}))"]
        return [clip(p, 0, 255) for p in parts]
    matrix = h273_matrix(mc)
    if forward:
        e = affine(d, matrix, [to_unit(d, v, 219.0, rgb_limited) for v in x])
        return [from_unit_luma(d, e[0], yuv_limited), from_unit_chroma(d, e[1], yuv_limited, standard), from_unit_chroma(d, e[2], yuv_limited, standard)]
    back = np.linalg.inv(np.vstack([matrix, [0, 0, 0, 1]]))[:3]
    e = affine(d, back, [to_unit(d, x[0], 219.0, yuv_limited), to_unit(d, x[1], 224.0, yuv_limited), to_unit(d, x[2], 224.0, yuv_limited)])
    return [from_unit_luma(d, v, rgb_limited) for v in e]


def transfer_matrix(mc: int) -> np.ndarray:
    """4 x 4 transfer matrix, RGB to YUV."""
    base = {0: [[0, 1, 0, 0], [0, 0, 1, 0], [1, 0, 0, 0]], 8: [[0.25, 0.5, 0.25, 0], [-0.25, 0.5, -0.25, 128 / 255], [0.5, 0, -0.5, 128 / 255]]}
    if mc == 10:
        r, b = H273_WEIGHTS[10]
        rows = [[1, 0, 0, 0], [r, 1 - r - b, b, 0], [0, 0, 1, 0]]
    else:
        rows = base.get(mc) or h273_matrix(mc)
    if mc == 14:
        raise ValueError("matrix coefficients 14 have no transfer matrix")
    return np.vstack([np.asarray(rows, float), [0, 0, 0, 1]])


def h273_transfer(d, x: list[str], mc: int, forward: bool, yuv_limited: bool = False, rgb_limited: bool = False) -> list[str]:
    """By one transfer matrix and its inverse."""
    m = transfer_matrix(mc)
    if forward:
        e = affine(d, m[:3], [to_unit(d, v, 219.0, rgb_limited) for v in x])
        return [from_unit_luma(d, e[0], yuv_limited), from_unit_chroma(d, e[1], yuv_limited), from_unit_chroma(d, e[2], yuv_limited)]
    e = affine(d, np.linalg.inv(m)[:3], [to_unit(d, x[0], 219.0, yuv_limited), to_unit(d, x[1], 224.0, yuv_limited), to_unit(d, x[2], 224.0, yuv_limited)])
    return [from_unit_luma(d, v, rgb_limited) for v in e]


def rounded_yuv(d, x: list[str], depth: int = 8, red: float = 0.877, blue: float = 0.492) -> list[str]:
    """RGB to YUV with rounded luma; 10 to 14 bits are computed at 16. Chroma uses the rounded luma."""
    up = 0 if depth in (8, 16) else 16 - depth
    top, off = ((1 << (depth + up)) - 1), 1 << (depth + up - 1)
    r, g, b = (f"({v} * {1 << up})" if up else v for v in x)
    y = floor_int(f"{d.num(0.299)} * {r} + {d.num(0.587)} * {g} + {d.num(0.114)} * {b} + {d.num(0.5)}")
    u = clip(floor_int(f"({b} - {y}) * {d.num(blue)} + {off} + {d.num(0.5)}"), 0, top)
    v = clip(floor_int(f"({r} - {y}) * {d.num(red)} + {off} + {d.num(0.5)}"), 0, top)
    return [d.shr(p, up) if up else p for p in (y, u, v)]


def rounded_rgb(d, x: list[str], depth: int = 8) -> list[str]:
    """YUV to RGB, the inverse factors of rounded_yuv."""
    up = 0 if depth in (8, 16) else 16 - depth
    top, off = ((1 << (depth + up)) - 1), 1 << (depth + up - 1)
    y, u, v = (f"({c} * {1 << up})" if up else c for c in x)
    r = f"{y} + {d.num(1.14)} * ({v} - {off})"
    g = f"{y} - {d.num(0.395)} * ({u} - {off}) - {d.num(0.581)} * ({v} - {off})"
    b = f"{y} + {d.num(2.032)} * ({u} - {off})"
    out = [clip(floor_int(f"{p} + {d.num(0.5)}"), 0, top) for p in (r, g, b)]
    return [d.shr(p, up) if up else p for p in out]


def convert_sql(d, name: str, direction: str, x: list[str]) -> list[str]:
    """Components by conversion name (unit, ycocg, ycocgr, h273.N, h273transfer.N, or a key of LINEAR) and direction (rgb2yuv, yuv2rgb)."""
    forward = {"rgb2yuv": True, "yuv2rgb": False}[direction]
    if name == "unit":
        return list(x)
    if name in ("ycocg", "ycocgr"):
        return (ycocg if name == "ycocg" else ycocgr)(d, x, forward)
    if name.startswith("h273transfer."):
        return h273_transfer(d, x, int(name.split(".")[1]), forward)
    if name.startswith("h273."):
        return h273(d, x, int(name.split(".")[1]), forward)
    return LINEAR[name, direction].sql(d, x)


def convert(df: DataFrame, name: str = "sdtv.computer", direction: str = "rgb2yuv", ins=("r", "g", "b"), outs=("c0", "c1", "c2")) -> DataFrame:
    """Adds the converted components."""
    return df.withColumns({o: F.expr(e) for o, e in zip(outs, convert_sql(Spark, name, direction, list(ins)), strict=True)})


def mosaic_differences(d, r: str, g1: str, g2: str, b: str, depth: int) -> dict[str, str]:
    """A 2 x 2 colour-filter cell to luma Y, green difference D, orange C and green c, all stored from 0 to the depth's maximum."""
    half = 1 << (depth - 1)
    store = lambda e: f"({d.shr(e, 1)} + {half})"
    orange = f"({r} - {b})"
    green = f"({d.shr(g1, 1)} + {d.shr(g2, 1)} - {d.shr(r, 1)} - {d.shr(b, 1)})"
    return {"Y": f"({d.shr(r, 2)} + {d.shr(g1, 2)} + {d.shr(g2, 2)} + {d.shr(b, 2)})", "D": store(f"({g2} - {g1})"), "C": store(orange), "c": store(green)}


def mosaic_from_differences(d, y: str, dg: str, co: str, cg: str, depth: int) -> dict[str, str]:
    """The inverse, up to the bits that storing dropped."""
    half, top = 1 << (depth - 1), (1 << depth) - 1
    load = lambda e: f"(({e} - {half}) * 2)"
    dg, co, cg = load(dg), load(co), load(cg)
    out = {"G": f"{y} - {d.shr(dg, 1)} + {d.shr(cg, 1)}", "g": f"{y} + {d.shr(dg, 1)} + {d.shr(cg, 1)}", "B": f"{y} - {d.shr(cg, 1)} - {d.shr(co, 1)}", "R": f"{y} - {d.shr(cg, 1)} + {d.shr(co, 1)}"}
    return {k: clip(f"({v})", 0, top) for k, v in out.items()}


def component(name: str, direction: str, ins, index: int) -> Column:
    return F.expr(convert_sql(Spark, name, direction, list(ins))[index])
